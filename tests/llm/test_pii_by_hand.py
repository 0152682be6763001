"""The personal-data model on letters written by hand, apart from the patterns it is trained on."""

from __future__ import annotations

import re

import numpy as np
import pytest

from radweave.llm import pii

MARK = re.compile(r"\[(name|phone|email|id_number|address):([^\]]*)\]")
LETTERS = """
Mrs [name:Halima Oyedepo] came for her yearly film. She can be called on [phone:0806 555 0142] in the evening.
Chest X-ray of [name:Gunnar Lindqvist], 54 years, smoker. Lungs clear, heart normal.
Reported by Dr [name:F. Castellano], 12 March 2021.
Please post the old films to [address:14 Juniper Street, Marlow].
Hospital no. [id_number:884213] - cough for three weeks.
Her daughter [name:Simone] will fetch the report; mail [email:simone.b@postbox.example].
Passport no. [id_number:K4471902] seen at the counter.
The patient lives at [address:Flat 3, 27 Orchard Lane, Tilbury].
Next of kin: [name:Abdul Rahman Siddiq], [phone:+44 20 7946 0011].
Discussed with Prof. [name:Ilse Brandt] of the heart clinic.
Kerley B lines at both bases. Film no. 884213, plate 22.
Accession 2210-88-31. The aorta is unfolded.
No pleural effusion or pneumothorax. Heart size normal, CTR 0.47.
Wristband no. [id_number:77-2031-8] checked by the nurse.
Write to [email:records (at) hillside.example] or ring [phone:(0161) 496-0733].
Name: [name:OKORO, Beatrice]. Age 33. Trader with fever since 3 May.
Batch 5511-20 of the contrast expired in June 2020.
Address: [address:P.O. Box 318, Ashby].
Repeat film in six weeks. CT is suggested if the nodule grows.
Typed by [name:M. Duarte].
""".strip().splitlines()


def _split(line):
    text, spans, at = "", set(), 0
    for m in MARK.finditer(line):
        text += line[at : m.start()]
        spans.add((len(text), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + line[at:], spans


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_letters_by_hand(model):
    rows = [_split(line) for line in LETTERS]
    found = pii.Decoder(model).find([t for t, _ in rows])
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    got = {(i, a, k) for i, spans in enumerate(found) for a, _, k in spans}
    assert len(want & got) >= 0.85 * len(want) and len(want & got) >= 0.85 * len(got), (sorted(want - got), sorted(got - want))


def test_weights_survive_storing(model, spark, tmp_path):
    again = pii.from_bytes(pii.to_bytes(model), model.vocabulary)
    assert np.array_equal(again.weight, model.weight) and again.known == model.known and again.index == model.index
    text = "Seen with her son Emre Aydin, tel 0212 555 01 44."
    assert pii.Decoder(again).find([text]) == pii.Decoder(model).find([text])
