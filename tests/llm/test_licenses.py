"""Licences that resemble each other, and rows of any kind."""

import textwrap

import pytest

from quillgraph.llm import op9_licenses as op9

GNU = "This {thing} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
NOTICES = {
    "AGPL-3.0-or-later": GNU.format(thing="program", a=":", kind="Affero ", b=",", v="3"),
    "GPL-3.0-or-later": GNU.format(thing="program", a=":", kind="", b=",", v="3"),
    "GPL-2.0-or-later": GNU.format(thing="program", a=";", kind="", b=";", v="2"),
    "LGPL-2.1-or-later": GNU.format(thing="library", a=";", kind="Lesser ", b=";", v="2.1"),
    "LGPL-3.0-or-later": GNU.format(thing="library", a=":", kind="Lesser ", b=",", v="3"),
    "BSD-2-Clause": op9._BSD.format(third=""),
    "BSD-3-Clause": next(t for k, t in op9.TEMPLATES if k == "BSD-3-Clause" and len(t) > 1000),
    "MIT": op9._MIT,
    "ISC": op9._ISC,
    "Zlib": op9._ZLIB,
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, license string, id int")
    return op9.scan_licenses(docs).collect()


@pytest.mark.parametrize("style", ["line", "wrapped", "commented", "one word changed"])
def test_each_notice_gives_its_own_licence_and_no_other(spark, style):
    def write(text):
        if style == "line":
            return f"Some tool.\n\n{text}\n\nMore about it."
        if style == "one word changed":
            return text.replace("conditions are met", "conditions hold").replace("published by", "issued by").replace("licensed under a", "licensed under the").replace("restriction", "limit")
        mark = "" if style == "wrapped" else " * "
        return "\n".join(mark + x for x in ["Some tool that does things", "", *textwrap.wrap(text, 60), "", "more about it"])

    rows = list(enumerate(NOTICES))
    got = {r.doc_id: [x.license for x in r.licenses] for r in _scan(spark, [(k, write(NOTICES[name])) for k, name in rows])}
    assert {name: got[k] for k, name in rows} == {name: [name] for _, name in rows}


def test_two_licences_of_different_families_are_both_found(spark):
    text = "Released under the MIT License.\n\n" + NOTICES["GPL-2.0-or-later"]
    assert sorted(x.license for x in _scan(spark, [(1, text)])[0].licenses) == ["GPL-2.0-or-later", "MIT"]
    two = NOTICES["AGPL-3.0-or-later"] + "\n\n" + NOTICES["LGPL-3.0-or-later"]
    assert sorted(x.license for x in _scan(spark, [(1, two)])[0].licenses) == ["AGPL-3.0-or-later", "LGPL-3.0-or-later"]


def test_ties_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under the MIT License.\nReleased under the MIT License."), (2, "Licensed under CC BY 4.0.\nLicensed under the MIT License.")]
    got = sorted((str(r.doc_id), [(x.license, round(x.dice, 6)) for x in r.licenses]) for r in _scan(spark, rows))
    # equal Dice: by name, the last first
    assert got == [("1", [("MIT", 1.0)]), ("1", [("MIT", 1.0)]), ("2", [("MIT", 1.0), ("CC-BY-4.0", 1.0)]), ("None", [("MIT", 1.0)])]
    assert [x.unit for r in _scan(spark, rows[2:3]) for x in r.licenses] == ["Released under the MIT License."]
