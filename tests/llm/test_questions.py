"""Questions that op3 must find in documents."""

import random

import pytest

from monthlens.llm import decontaminate as D

PAD = "Some other words stand before it and some stand after it too. "


@pytest.fixture(params=[2_000_000, 0])
def found(spark, documents, monkeypatch, request):
    """Pairs (doc_id, item_id) of (doc_id, text) and (item_id, text), and their rows."""
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", request.param)

    def run(rows, questions):
        bench = spark.createDataFrame(questions, "item_id long, text string")
        return {(r.doc_id, r.item_id): r for r in D.leaks(documents(rows), bench).collect()}

    return run


def test_short_question_within_a_document(found):
    questions = [(1, "What is water made of?"), (2, "Who painted the old wall behind the house in the garden of roses?")]
    rows = [
        (1, PAD * 3 + questions[0][1] + " " + PAD * 3), (2, questions[0][1]), (3, PAD * 3), (4, PAD + questions[1][1] + " " + PAD),
        (5, "What is water?"), (6, PAD + questions[1][1] + " " + questions[0][1]),
    ]
    got = found(rows, questions)
    assert set(got) == {(1, 1), (2, 1), (4, 2), (6, 1), (6, 2)}
    assert all(r.coverage == 1.0 and r.n_changed == 0 for r in got.values())
    assert got[1, 1].n_windows == 1


def test_verbatim_windows_count_beside_a_clash(found):
    questions = [
        (1, "Yesterday Tom had 5 apples and a basket of pears when the market closed and the rain began to fall on the roofs of the town, so he went home where Tom slept."),
        (2, "Yesterday Tom had 5 apples and Mary had 7 apples. How many apples do Tom and Mary have together in the basket?"),
    ]
    rows = [
        (1, PAD + questions[0][1].replace("Tom slept", "Ann slept") + " " + PAD),  # most windows stand as they are
        (2, PAD + questions[0][1].replace("Tom had", "Ann had") + " " + PAD),
        (3, PAD + "Yesterday Jim had 8 apples and Sue had 8 apples. How many apples do Ann and Ben have together in the basket?"),  # clashes, nothing as it is
        (4, PAD + "Yesterday Jim had 8 apples and Sue had 9 apples. How many apples do Jim and Sue have together in the basket?"),
    ]
    got = found(rows, questions)
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert got[1, 1].n_windows > got[1, 1].n_matched and got[4, 2].coverage == 1.0 and got[4, 2].n_changed == 4


def test_windows_of_few_plain_words_count_as_they_are(found):
    questions = [
        (1, "12 + 30 5 7 11 + 40 9 18 21 + 3 = 8 66 9 10"),
        (2, "and Paul Anna, 5 km 7 km 9 km 11 kg 30 kg from Lyon, Rome 4 5 6"),
        (3, "Yesterday Tom had 5 apples and Mary had 7 apples. How many of them were there? 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
    ]
    rows = [
        (1, PAD + questions[0][1] + " " + PAD), (2, PAD + questions[1][1] + " " + PAD),
        (3, PAD + "12 + 31 5 8 11 + 41 9 19 21 + 4 = 9 66 8 10 " + PAD),  # other values
        (4, PAD + questions[2][1].replace("Tom", "Jim").replace("had 5", "had 8") + " " + PAD),  # its plain part has other values
        (5, PAD + "How many of them were there? 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),  # most of all windows
        (6, PAD + questions[1][1].replace("Paul Anna", "Anna Paul").replace("7 km", "8 km").replace("30 kg", "31 kg")),
    ]
    got = found(rows, questions)
    assert set(got) == {(1, 1), (2, 2), (4, 3), (5, 3)}
    assert got[1, 1].coverage == 1.0 and got[2, 2].coverage == 1.0 and got[1, 1].n_changed == 0


def test_copies_in_another_case(found):
    questions = [
        (1, "In March Paul Keller of Zurich sold 12 boxes of Swiss cheese to Anna Meyer. How many boxes had Paul left on Friday?"),
        (2, "What is the capital of the country whose flag shows a red disc on a plain white ground?"), (3, "Who wrote Faust?"),
    ]
    rows = [(10 * k + j, PAD + change(q) + " " + PAD) for k, q in questions for j, change in enumerate((str, str.lower, str.upper, str.title))]
    got = found([*rows, (90, PAD * 3), (91, "in march paul keller of zurich went home")], questions)
    assert set(got) == {(10 * k + j, k) for k, _ in questions for j in range(4)}
    assert all(r.coverage == 1.0 and r.n_changed == 0 for r in got.values())


def test_folded_windows_by_brute_force(found):
    """Pairs found among texts without any capital, number or unit are those of shared windows."""
    rnd = random.Random(8)
    words = [f"{a}{b}ar" for a in "bcdrst" for b in "aeiou"]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    questions = {k: text(rnd.choice([3, 8, 12, 20])) for k in range(12)}
    docs = {}
    for k in range(40):
        q = list(questions[rnd.randrange(12)])
        for _ in range(rnd.randrange(3)):
            q[rnd.randrange(len(q))] = "zzar"
        docs[k] = [w.upper() if rnd.random() < 0.5 else w for w in text(rnd.randrange(20)) + q + text(5)]

    def windows(ws, n):
        return [tuple(w.lower() for w in ws[i : i + n]) for i in range(len(ws) - n + 1)]

    want = set()
    for d, ws in docs.items():
        for k, q in questions.items():
            n = min(8, len(q))
            have = set(windows(ws, n))
            mine = windows(q, n)
            if sum(w in have for w in mine) >= 0.5 * len(mine):
                want.add((d, k))
    assert want
    got = found([(d, " ".join(ws)) for d, ws in docs.items()], [(k, " ".join(q)) for k, q in questions.items()])
    assert {p for p in got if p in want} == want
    # what else is found stands in the document as a template, with other values
    assert all(r.n_changed > 0 for p, r in got.items() if p not in want)
