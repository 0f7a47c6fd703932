"""Each kind in its forms, what is not personal, placeholders, and the lexicon by join."""

import pytest

from billspark.llm import pii as P

FAC = P.Facilities.of([("Corvane Medical Center", "1906 Sparrow Parkway, Mirrow, NV 91449", "(541) 555-0146", "pay.corvane-care.example", "1906 Sparrow Parkway, Mirrow, NV 91449"), (None, None, None, None, None)])
NAMES = {"gisela": "f", "oren": "f", "lindström": "l", "dunwick": "l", "corvane": "l"}
FINDER = P.Finder(FAC)


def kinds(text):
    return [(text[a:b], k) for a, b, k in FINDER.places(text, NAMES.get)]


@pytest.mark.parametrize(("text", "want"), [
    ("Write to a.b+c@mail.example.", [("a.b+c@mail.example", "email")]), ("X_Y1 @ home.example, daily", [("X_Y1 @ home.example", "email")]), ("me (at) in-box (dot) quill (dot) test. Reply", [("me (at) in-box (dot) quill (dot) test", "email")]), ("oren dunwick at box dot example", [("dunwick at box dot example", "email")]),
    ("billing@corvane-care.example or see you at the desk @ noon", []), ("Call (541) 555-0146", []), ("cell +1(219)555.0199 or 2195550110", [("+1(219)555.0199", "phone"), ("2195550110", "phone")]), ("claim 2195550110, invoice 2024-00872, $1,234.50", []),
    ("my SSN 912-34-5678", [("912-34-5678", "identity_number")]), ("social: 912345678", [("912345678", "identity_number")]), ("social security number is 912 34 5678", [("912 34 5678", "identity_number")]), ("member ID TDZ5052171, medical record number 00428683", [("TDZ5052171", "identity_number"), ("00428683", "identity_number")]),
    ("driver's license K283651-29", [("K283651-29", "identity_number")]), ("patient account PA-2024-00001", [("PA-2024-00001", "identity_number")]), ("what is my patient account number?", []), ("social media posts", []),
    ("I live at 12 Alder Hollow Rd #12, Port Vashna, MT 94888 now", [("12 Alder Hollow Rd #12, Port Vashna, MT 94888", "street_address")]), ("moved to 816 blue heron avenue, unit 7", [("816 blue heron avenue, unit 7", "street_address")]), ("Mail to 1906 Sparrow Parkway, Mirrow, NV 91449 or P.O. Box 4430", []), ("I have 20 bills in the way", []),
    ("Gisela Lindström called", [("Gisela Lindström", "person_name")]), ("DUNWICK, OREN is printed", [("DUNWICK, OREN", "person_name")]), ("Can V. Dunwick sign", [("V. Dunwick", "person_name")]), ("Nobody told Oren.", [("Oren", "person_name")]), ("this is oren dunwick writing", [("oren dunwick", "person_name")]), ("Oren Unheardof came", [("Oren Unheardof", "person_name")]), ("Oren Thanks you", [("Oren", "person_name")]),
    ("at 12 Old North Church Hill Lane, Apt 4", [("12 Old North Church Hill Lane, Apt 4", "street_address")]), ("the 12 forms that nobody filled went this way", []), ("x" * 200 + "@mail.example", [("x" * 200 + "@mail.example", "email")]), ("5 " + "Longname" * 12 + " Street", [("5 " + "Longname" * 12 + " Street", "street_address")][:0]), ("51 " + "Longname" * 12 + " Street", [("51 " + "Longname" * 12 + " Street", "street_address")]),
    ("Thank you, and this is the letter. Nobody told me about it. Regards, the office", []),
    ("Corvane Medical Center", []), ("oren.dunwick@mail.example", [("oren.dunwick@mail.example", "email")]), ("", []), (None, []), ("   ", []),
])
def test_places(text, want):
    assert kinds(text) == want


def test_mask_keeps_the_rest():
    t = "I am Oren Dunwick, oren@mail.example, SSN 912-34-5678."
    assert P.mask(t, FINDER.places(t, NAMES.get)) == "I am [PERSON_NAME], [EMAIL], SSN [IDENTITY_NUMBER]."
    assert P.mask(None, []) is None and P.mask("x", []) == "x"


def test_long_text():
    t = "no places here, 12 of them. " * 20_000 + "a@b.example"
    assert kinds(t) == [("a@b.example", "email")]


ROWS = [(1, "Oren Dunwick lives at 12 Alder Rd", "a@b.example"), (1, "Oren Dunwick lives at 12 Alder Rd", "a@b.example"), (2, None, ""), (3, "nothing", "Gisela")]


def test_columns_and_lexicon_by_join(spark):
    df = spark.createDataFrame(ROWS, "id long, a string, b string").selectExpr("*", "'k' as _names", "'w' as word")
    people = spark.createDataFrame([("Gisela Lindström",), ("Oren Dunwick",), (None,), ("One",), ("",)], "n string")
    lex = P.lexicon_of(people, "n")
    assert {(r["word"], r["kind"]) for r in lex.collect()} == {("gisela", "f"), ("oren", "f"), ("lindström", "l"), ("dunwick", "l")}
    one, two = (sorted(map(str, P.find_places(df, ["a", "b"], FAC, lex, ["id"], masked=True, broadcast_words=n).collect())) for n in (100, 1))
    assert one == two and len(one) == 4
    got = P.find_places(df, ["a", "b"], FAC, lex, ["id"], masked=True).where("id = 1").head()
    assert got["a_masked"] == "[PERSON_NAME] lives at [STREET_ADDRESS]" and [p["kind"] for p in got["b_places"]] == ["email"]
    assert P.find_places(df.limit(0), ["a"], FAC, lex.limit(0), ["id"]).count() == 0


def test_marked_names_by_join(spark):
    texts = ["Dana O'Brien called", "ask Smith-Jones's office, or Jean-Luc", "Oren’s bill", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, a string")
    lex = P.lexicon_of(spark.createDataFrame([("Dana O'Brien",), ("Jean-Luc Smith-Jones",), ("Oren Dunwick",)], "n string"), "n")
    one, two = ({r["id"]: [tuple(p) for p in r["a_places"]] for r in P.find_places(df, ["a"], FAC, lex, ["id"], broadcast_words=n).collect()} for n in (100, 1))
    assert one == two and [len(one[k]) for k in range(5)] == [1, 2, 1, 0, 0]


def test_names_told_by_the_texts(spark):
    """Wordings that are not in the code, no lexicon: at least nine of ten names are found, and no other words."""
    people = [("Wanda", "Pell"), ("Marisol", "Oduya"), ("Tomasz", "Kovač"), ("Ines", "Abara"), ("Rufus", "Thackery"), ("Priya", "Venkat"), ("Soren", "Halvard"), ("Bettina", "Crowe")]
    wordings = ["Could you please have {f} {l} call us back on Friday?", "The form was signed by {f} {l} in March.", "Dr. {l} saw the patient.", "We already talked with Ms. {l} about it.", "My aunt {f} pays the rent.", "Attn: {f} {l}", "{l}, {f} is the policyholder.", "The claim of {f} was sent twice, said the office.", "Yours truly, {f} {l}", "our neighbor {f} drove me to Corvane Medical Center in Mirrow", "Ask {f} whether the plan paid."]
    texts, want = [], []
    for i, (f, l) in enumerate(people):
        for j, w in enumerate(wordings):
            texts.append(w.format(f=f, l=l))
            want.append([x for x in (f, l) if "{" + ("f" if x == f else "l") + "}" in w])
    texts += ["Could the Billing Office send the claim in March? Nobody told us. Please ask the Patient Financial Services.", "Waiting helps. Charges may change, said the plan. Bring the card.", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, a string")
    learnt = P.corpus_names(df, ["a"], FAC)
    none = spark.createDataFrame([], "word string, kind string")
    got = {r["id"]: [texts[r["id"]][p["start"] : p["stop"]] for p in r["a_places"]] for r in P.find_places(df, ["a"], FAC, P.merged_lexicon(none, learnt), ["id"]).collect()}
    met = [x in " ".join(got[i]) for i, names in enumerate(want) for x in names]
    assert sum(met) >= 0.9 * len(met)
    known = {x for p in people for x in p}
    assert all(set(P._WORD.findall(x)) <= known for i in got for x in got[i])
    assert P.corpus_names(df.limit(0), ["a"], FAC).count() == 0
    assert {r["word"] for r in P.corpus_names(df, ["a"], FAC, spark.createDataFrame([("pell",)], "word string")).collect()} == {r["word"] for r in learnt.collect()} - {"pell"}


def test_bitmap_lets_every_key_through(spark):
    from pyspark.sql import functions as F

    from billspark.llm import bitmap

    words = ["a", "ñandú", "O'Brien", *[f"w{i}" for i in range(500)]]
    bits = bitmap.bitmap_of(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), F.xxhash64("word"))
    assert len(bits) == bitmap.BITS // 8 and all(bitmap.has(bits, bitmap.hashed(w)) for w in words)
    assert sum(bitmap.has(bits, bitmap.hashed(f"x{i}")) for i in range(500)) < 3
