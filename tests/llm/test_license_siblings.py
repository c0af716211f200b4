"""Sibling licenses get their own names."""

import pytest

from ledgerlens.llm.licenses import TEMPLATES, license_scan

FILLER = " ".join(f"z{k}" for k in range(60))
GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
       "published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
       "version.")


@pytest.fixture(scope="module")
def named(spark):
    texts = [text for _, text in TEMPLATES]
    texts += [
        GNU.format("Affero General Public License", "3"), GNU.format("General Public License", "3"),
        GNU.format("General Public License", "2") + " " + FILLER + " " + GNU.format("General Public License", "3"),
        "Copyright holders of this. " + GNU.format("Lesser General Public License", "3").replace("modify", "change"),
    ]
    rows = [(k, f"{FILLER} {text} {FILLER}") for k, text in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, FILLER)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in license_scan(frame, best=True).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    return found


def test_each_notice_has_its_own_license_only(named):
    assert [named.get(k) for k in range(len(TEMPLATES))] == [{name} for name, _ in TEMPLATES]


def test_near_variants(named):
    n = len(TEMPLATES)
    assert named[n] == {"AGPL-3.0"} and named[n + 1] == {"GPL-3.0"}
    assert named[n + 2] == {"GPL-2.0", "GPL-3.0"}
    assert named[n + 3] == {"LGPL-3.0"}
    assert not {900, 901, 902} & set(named)
