"""The matching cascade against a small register."""

from posora.operators.matching import METHODS, matched

REGISTER = [
    ("Alpha Acid", "U1", "d"), ("ALPHA  acid", "U1", "c"), ("Twin", "U2", "d"), ("twin", "U3", "d"), ("Beta-x", "U4", "d"), ("St John's wort", "U5", "d"),
    ("Iobenguane (123I)", "U6", "d"), ("Other", "U1", "d"), ("Fluorine 18F", "U7", "d"), (None, "U8", "d"),
]
ALIASES = [
    (METHODS[1], "Alfa Acid", "alpha acid", "U1"), (METHODS[2], "Bee", "Beta-x", "U4"), (METHODS[1], "Wrong", "beta-x", "U1"), (METHODS[1], "Twine", "Twin", "U2"),
]
WANTED = {
    "alpha acid": [("selected", METHODS[0], "U1")], "TWIN": [("ambiguous", METHODS[0], "U2"), ("ambiguous", METHODS[0], "U3")], "alfa acid": [("selected", METHODS[1], "U1")],
    "bee": [("selected", METHODS[2], "U4")], "wrong": None, "twine": None, "Alpha Acid (경구)": [("selected", METHODS[3], "U1")], "Beta-x 함유제제": [("selected", METHODS[3], "U4")],
    "Alpha acid = other": [("selected", METHODS[4], "U1")], "Alpha acid = Beta-x": None, "Other (Alpha Acid)": [("selected", METHODS[4], "U1")], "Twin (Other)": None,
    "β-x": [("selected", METHODS[5], "U4")], "St. John’s wort": [("selected", METHODS[6], "U5")], "Iobenguane( 123 I )": [("selected", METHODS[7], "U6")],
    "Fluorine(18 F)": [("selected", METHODS[7], "U7")], "nothing": None, "": None,
}


def test_cascade(spark):
    local = spark.createDataFrame([(n,) for n in [*WANTED, "bee", None]], "name string")
    register = spark.createDataFrame(REGISTER, "name string, substance_id string, dataset string")
    aliases = spark.createDataFrame(ALIASES, "method string, name string, evidence_name string, substance_id string")
    got = {}
    for r in matched(local, register, aliases).collect():
        got.setdefault(r.name, []).append((r.status, r.method, r.substance_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: v or [("unsolved", None, None)] for k, v in WANTED.items()}
    assert matched(local, register.limit(0), aliases.limit(0)).filter("status <> 'unsolved'").count() == 0
