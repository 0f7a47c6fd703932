"""Each kind of defect and its near misses; the common subsequence against the plain matrix."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from billspark.llm import pairs as P

Q = "My plan is HDHP and my second insurance is Bluefern Mutual. Who pays first for the echo study?"
ES = "Recibí dos cartas por $90, ¿cuál debo pagar primero? My name is Goran Lind. I live at 12 Alder Way."
A = "The counselor can set up monthly payments over 3 months. Please keep the explanation next to the statement."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], last + 1 if x == y else max(d[j], d[j - 1])
    assert P.lcs(a, b) == d[-1]


@pytest.mark.parametrize(("prompt", "answer", "defect"), [
    (Q, None, "empty"), (Q, "  ", "empty"), (Q, "N/A", "empty"), (Q, "…", "empty"), (None, "x", "no_pair"), (" ", "x", "no_pair"),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"> {Q}", "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, Q.replace("second ", "").replace(".", ""), "copy"),
    (Q, f"> {Q}\n\nYou owe $20 after Bluefern Mutual paid $7,920.", None), (Q, f'You asked: "{Q}"\n\nTo check that, please upload the bill so I can read the lines.', None),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Thank you for your message. I’d rather not comment on your bill. Please contact someone who can.", "refusal"), (Q, "I CANNOT ASSIST WITH THAT. I HOPE YOU UNDERSTAND.", "refusal"), (ES, "Lo siento, no puedo ayudarle con eso.", "refusal"),
    # refusals of any length, with numbers, and others named to ask
    (Q, "Sorry, this is something I cannot assist with. I hope you understand. " * 10, "refusal"), (Q, "I can't help with that. Please call 911.", "refusal"), (Q, "I'm unable to provide an answer here. You can contact the billing office at (541) 555-0146 instead.", "refusal"),
    (Q, "I am sorry to say that after reading all of this twice and thinking about it for quite some time I still cannot answer that question for you today.", "refusal"), (Q, "I cannot assist with that. Your share is $40 after the plan paid.", None), (Q, "Please call 911.", None), (Q, "The plan cannot answer before the review ends. You owe $40.", None),
    # copies repeated any number of times, blank answers of any length
    (Q, "\n".join([Q] * 3), "copy"), (Q, " ".join([Q] * 40), "copy"), (Q, "You asked: " + " ".join([Q] * 5), "copy"), (Q, f"{Q} {Q} {A}", None), (Q, A * 40, None), (Q, " \n" * 100, "empty"), (Q, "\u200b" * 100, "empty"),
    (Q, "I can't give legal advice, but I can explain what the notice means.", None), (Q, f"I am not able to confirm eligibility for you, though I can show how it works. {A}", None), (Q, "Hello!", None),
    (Q, "No envíe dinero hasta que la revisión haya terminado.", "other_language"), (Q, "Sie haben 45 Tage Zeit, schriftlich Einspruch einzulegen.", "other_language"), (Q, "Не переводите деньги, пока идёт проверка.", "other_language"), (Q, "Đừng gửi tiền khi việc xem xét chưa kết thúc.", "other_language"),
    (ES, "No envíe dinero hasta que la revisión haya terminado.", None), (ES, A, "other_language"), (Q, f'{A} The word "pago" on the Spanish copy marks the payment.', None), (Q, "2024", None), (Q, A, None),
])
def test_defect(prompt, answer, defect):
    assert P.defect(prompt, answer) == defect


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("i can not help with that question please".split()), min_size=1, max_size=40))
def test_alignment_equals_brute_force(w):
    t = P.Templates(["i can not help with that", "please help", "that question i can not help with please"])
    plain = [x.split() for x in ("i can not help with that", "please help", "that question i can not help with please")]
    want = w in plain or len(w) > 1 and any(len(x) > 2 and 0.5 < len(w) / len(x) < 2 and 2 * P.lcs(x, w) >= 0.75 * (len(x) + len(w)) for x in plain)
    assert t.aligns(w) == want


def test_pairs(spark):
    base = [(i, "s", "initial", f"{A} Charges stay with you.", None, Q) for i in range(20)]
    rows = [*base, (50, "s", "initial", None, None, Q), (50, "s", "initial", None, None, Q), (51, None, "followup", "The counselor can set up mon", None, Q), (52, "s", "initial", None, None, None), (53, "s", "initial", "x y", None, " ")]
    df = spark.createDataFrame(rows, "id long, source string, field string, text string, sibling string, prompt string").selectExpr("*", "'k' as label", "3 as defect")
    assert {tuple(r) for r in P.broken_pairs(df).collect()} == {(50, "initial", "empty"), (51, "followup", "truncated")}
    assert P.broken_pairs(df).count() == 2 and P.broken_pairs(df.limit(0)).count() == 0
