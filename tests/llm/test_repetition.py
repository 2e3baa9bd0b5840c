import random

from sedimenta.llm import repetition
from tests.conftest import DATA


def brute(text, n=8):
    words = "".join(c for c in text.lower() if c.isalpha() or c.isnumeric() or c.isspace()).split()
    seen, covered = {}, set()
    for i in range(len(words) - n + 1):
        stretch = tuple(words[i : i + n])
        if stretch in seen:
            covered.update(range(i, i + n))
        seen.setdefault(stretch, i)
    return len(words), len(covered)


def test_random_texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c A. ñ, -".split(), k=rng.randint(0, 60))) for _ in range(2000)] + ["a " * 5000, "", "  ", "uno", "a\xa0b　c\x1cd"]
    n, again = repetition.repeated(texts)
    assert list(zip(n.tolist(), again.tolist())) == [brute(t) for t in texts]
    assert repetition.repeated([])[0].tolist() == []


def test_one_text_does_not_touch_another():
    same = "uno dos tres cuatro cinco seis siete ocho"
    assert repetition.repeated([same, same, f"{same} {same}"])[1].tolist() == [0, 0, 8]


def test_operator(spark):
    eight = "uno dos tres cuatro cinco seis siete ocho"
    rows = [(1, f"{eight} {eight}"), (2, None), (3, ""), (4, eight), (4, eight), (None, f"{eight}, {eight.upper()}!"), (5, f"{eight} {eight} a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS share")
    got = repetition.repetition(df).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["words"], r["repeated_words"]) for r in got} == {(1, 16, 8), (2, 0, 0), (3, 0, 0), (4, 8, 0), (None, 16, 8), (5, 28, 8)}
    assert sorted(map(str, (r[0] for r in repetition.repetitive(df).collect()))) == ["1", "None"]
    assert repetition.repetitive(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"] for r in docs.collect() if r["text"] and (w := brute(r["text"]))[1] and 10 * w[1] >= 3 * w[0]}
    assert {r[0] for r in repetition.repetitive(docs).collect()} == want
