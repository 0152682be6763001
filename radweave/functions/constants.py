"""Fixed values of the rule extractor, the policies and the de-identification rules."""

from __future__ import annotations

# Blanks that a Unicode-aware strip or split removes, as a character class body for both regex engines in use.
BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Section keys in their order, and section weights.
SECTIONS = ("findings", "impression", "conclusion", "summary", "comments", "body")
SECTION_WEIGHT = {"findings": 0.50, "impression": 0.70, "conclusion": 0.70, "summary": 0.70, "comments": 0.50, "body": 0.50}

# Words that negate a finding on their right.
NEGATIONS = (
    "no", "without", "absence of", "not seen", "clear of", "negative for", "no evidence of", "free of", "no gross", "ruled out", "excluded",
    "no significant", "no definite", "no focal", "no active", "no acute", "no obvious", "does not show", "not demonstrate", "not identified",
)

# Words of uncertainty; a question mark counts too.
UNCERTAIN = (
    "likely", "suggestive of", "probable", "cannot exclude", "may represent", "possibly", "could represent", "cannot rule out", "questionable", "equivocal",
    "appears to", "consistent with", "raising the possibility",
)

# Words that hint at an abnormality.
CUES = (
    "opacity", "opacities", "infiltrate", "infiltrates", "lesion", "shadow", "shadows", "mass", "nodule", "effusion", "collapse", "atelectasis", "edema", "fibrosis",
    "consolidation", "cavitation", "haze", "prominence", "airspace", "haziness", "widening", "blunting", "blunted", "obscured", "obliteration", "deviation",
    "enlarged", "enlargement", "elevated", "thickening",
)

# Phrases that mean pneumonia only beside one of the confirming words.
AMBIGUOUS = ("homogeneous opacity", "homogenous opacity", "inhomogenous opacity", "inhomogeneous opacity", "ill-defined opacity", "ill defined opacity", "veil opacity")
CONFIRMING = ("pneumoni", "consolidat", "bronchopneumoni", "aspiration", "lobar", "segmental", "airspace disease", "air space disease", "infiltrat", "pneumonic")

# Vascular words without which pulmonary edema is not scored.
VASCULAR = (
    "vascular congestion", "pulmonary vascular congestion", "cephalization", "kerley", "interstitial edema", "alveolar edema", "fluid overload", "cardiac failure",
    "pulmonary venous hypertension", "perihilar haze", "pulmonary congestion", "pulmonary edema", "bat-wing", "bat wing",
)

# Phrases of cardiomegaly left to the numeric ratio.
RATIO_PHRASES = ("ctr", "cardiothoracic ratio")

# Labels in alphabetical order, and those with a policy of their own.
LABELS = (
    "Atelectasis", "Cardiomegaly", "Degenerative / Structural Changes", "Device Present", "Lung Mass / Nodule", "Other Significant Abnormality", "Pleural Effusion",
    "Pneumonia / Consolidation", "Post-Surgical Changes", "Pulmonary Edema", "Reticulonodular / Interstitial Pattern", "Suspected Malignancy", "Tuberculosis",
)
MODEL_PRIMARY = ("Other Significant Abnormality", "Suspected Malignancy")
RARE = ("Lung Mass / Nodule", "Post-Surgical Changes", "Pulmonary Edema")
HIGH_RISK = ("Tuberculosis", "Lung Mass / Nodule", "Suspected Malignancy")

# Patterns of the ratio, the heading line and the section headers.
RATIO = r"(?:ctr|cardiothoracic ratio)[" + BLANKS + r"]*[-:=][" + BLANKS + r"]*0?\.?([0-9]{2,3})"
HEADER = r"(?i)^[" + BLANKS + r"]*CHEST[" + BLANKS + r"]+RADIOGRAPH?Y?[" + BLANKS + r"]+(?:REPORT|====.*?====)[^\n]*\n?"
LAST_PART = r"(?i)(?:^|\n)[" + BLANKS + r"]*(impression|conclusion|summary)[" + BLANKS + r"]*:?[" + BLANKS + r"]*\n?"
FIRST_PART = r"(?im)^(findings|comments)[" + BLANKS + r"]*:?[" + BLANKS + r"]*\n?"


def whole_words(options: tuple[str, ...]) -> str:
    """Pattern of any of the options not touching a letter, digit or underscore; the same in both regex engines."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(options) + r")(?:$|[^\p{L}\p{N}_])"
