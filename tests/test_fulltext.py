"""Full text against a brute-force version on random texts; what a question's plan reads of the index."""

import random
import re

from pyspark.sql import functions as F

from memlake.operators import fulltext, lexical, search

DOCS = "other string, document string, id long, qid int"
WORDS = ["cat", "cats", "run", "running", "the", "of", "dog's", "blue", "hopped", "agreed", "ponies", "sky"]


def words(text):
    return re.findall(r"\w+", text.lower())


def lexemes(text):
    return [(i, fulltext.stem(w)) for i, w in enumerate(words(text), 1) if w not in fulltext.STOP]


def brute(question, text):
    """Number of covers and density by looking at every stretch of positions; None without a match."""
    held = lexemes(text)
    at = {}
    for i, w in held:
        at.setdefault(w, set()).add(i)
    groups, group = [], []
    for part in re.findall(r'-?"[^"]*"?|[^\s"]+', question.lower()):
        if part == "or":
            groups, group = [*groups, group], []
        else:
            group.append((bool(re.match("-.", part)), lexemes(part)))
    met, positions = [], set()
    for group in [*groups, group]:
        items, barred = [], False
        wanted = [x for neg, x in group if x and not neg]
        for neg, lex in group:
            if not lex:
                continue
            offsets = [(i - lex[0][0], w) for i, w in lex]
            found = [(s, s + offsets[-1][0]) for s in range(-9, len(words(text)) + 2) if all(s + o in at.get(w, ()) for o, w in offsets)]
            if neg:
                barred |= bool(found)
            elif found:
                items.append(found)
                if wanted:
                    positions |= {i for _, w in offsets for i in at[w]}
        if wanted and len(items) == len(wanted) and not barred:
            met.append(items)
    if not met:
        return None
    n = len(words(text))
    holds = lambda a, b: any(all(any(a <= s and e <= b for s, e in own) for own in items) for items in met)
    covers = [(a, b) for a in range(1, n + 1) for b in range(a, n + 1) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
    return len(covers), round(sum(0.1 / (1 + b - a + 1 - len([p for p in positions if a <= p <= b])) for a, b in covers), 9)


def test_stems():
    told = {"cats": "cat", "caresses": "caress", "ponies": "poni", "pony": "poni", "agreed": "agree", "feed": "feed", "hopped": "hop", "hopping": "hop", "rating": "rate", "enabled": "enable", "falling": "fall", "sky": "sky", "sing": "sing", "glass": "glass", "is": "is", "über": "über", "x2s": "x2s"}
    assert {w: fulltext.stem(w) for w in told} == told


def test_stems_are_the_same_in_columns(spark):
    r = random.Random(1)
    some = ["".join(r.choice("aeiobdgmstyzl") for _ in range(r.randrange(1, 6))) + r.choice(["", "s", "es", "ed", "eed", "ing", "y", "ies"]) for _ in range(3000)] + WORDS
    got = spark.createDataFrame([(w,) for w in some], "w string").select("w", fulltext.stem_column(F.col("w")).alias("s")).collect()
    assert [(x.w, x.s) for x in got if x.s != fulltext.stem(x.w)] == []


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", "the of", *(" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 25))) for _ in range(120))]
    docs = spark.createDataFrame([("x", t, i, 7) for i, t in enumerate(texts)], DOCS)
    fulltext.build(docs, str(tmp_path / "index"))
    index = lexical.load(spark, str(tmp_path / "index"))
    assert index.n == len(texts)
    asked = ["cat", "running cats", '"cat run"', '"cats of runs"', "cat or sky", "cat -sky", "sky or blue cat -hop", '-"cat cat"', "the of", "", 'blue "dog\'s sky', "or or cat", "-cat blue", 'agree or "pony run" -"blue sky"', '"cat cat"', "cat cat"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    got = {(x.qid, x.id): (x.covers, round(x.density, 9)) for x in fulltext.match(index, questions).collect()}
    want = {(q, i): b for q, t in enumerate(asked) for i, d in enumerate(texts) if (b := brute(t, d or ""))}
    assert got == want and len(want) > 200
    some = docs.where("id % 2 = 0").select("id")
    assert {k for k in want if k[1] % 2 == 0} == {(x.qid, x.id) for x in fulltext.match(index, questions, among=some).collect()}
    best = fulltext.search(index, questions, 1).where("qid = 0").first()
    assert best.id == min((i for q, i in want if q == 0), key=lambda i: (-want[0, i][1], i))
    assert fulltext.match(index, questions.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_question_reads_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([("x", f"word{i} word{i % 7} common", i, 0) for i in range(300)], DOCS)
    lexical.build(docs, str(tmp_path / "index"))
    index = lexical.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, ["word3", "common"]), (2, ["word299"])], "qid long, terms array<string>")
    plan = plan_of(lexical.search(index, asked, 5))
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("bucket#" in x.split("PartitionFilters: [")[1].split("]")[0] and " IN (" in x.split("PartitionFilters: [")[1] for x in scans)
    assert all("In(term, [" in x for x in scans)
    got = [(x.qid, x.id) for x in lexical.search(index, asked, 2).orderBy("qid", "rank").collect()]
    assert got[0] == (1, 3) and got[2:] == [(2, 299)]


def test_many_terms_are_joined_with_the_same_result(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("x", f"word{i % 11} word{i % 7} common", i, 0) for i in range(60)], DOCS)
    lexical.build(docs, str(tmp_path / "index"))
    index = lexical.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, [f"word{i}", f"word{i + 1}", "none"]) for i in range(9)], "qid long, terms array<string>")
    rows = lambda: sorted((x.qid, x.id, round(x.bm25, 9)) for x in lexical.search(index, asked).collect())
    first = rows()
    monkeypatch.setattr(lexical, "LITERALS", 3)
    assert rows() == first and first


def test_fusion_with_full_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "blue cats", [1.0, 0.0]), (2, "blue dogs", [0.0, 1.0]), (3, "cat", [0.9, 0.1])], "id long, document string, embedding array<double>")
    fulltext.build(rows, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "blue dog", [1.0, 0.0])], "qid long, question string, embedding array<double>")
    got = search.hybrid_query(rows, asked, lexical.load(spark, str(tmp_path / "index")), exact=True)
    assert [(x.id, round(x.rrf, 6)) for x in got.orderBy("rank").collect()] == [(2, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
