"""radweave: report labelling and corpus analytics as Spark DataFrame plans.

The extractors and their parts are exported from here and loaded on first use.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "Lexicon": "operators.rules", "with_labels": "operators.rules", "label_list": "operators.rules", "with_hits": "operators.rules", "with_sections": "operators.sections",
    "with_spans": "operators.spans", "ruled_spans": "operators.spans", "weak_labels": "operators.spans", "guarded": "operators.spans", "score_texts": "operators.scorer", "Scorer": "operators.scorer",
    "entity_texts": "operators.scorer", "fold_average": "operators.scores", "decisions": "operators.ensemble", "disagreements": "operators.ensemble", "summary": "operators.ensemble",
    "full_record": "operators.ensemble", "union_vote": "operators.ensemble", "with_hierarchy": "operators.hierarchy", "LABELS": "functions.constants", "unpack": "operators.packed",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"radweave.{_EXPORTS[name]}"), name)
