"""Each stage of the pipeline against a plain version of what it states, with repeated and null ids."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipe  # noqa: E402
from sightline.llm import common, pii, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs(spark, texts):
    common.prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def test_toxic_documents_go_and_others_stay(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    odd = _docs(spark, [(None, "you idiot"), (-1, None), (-2, ""), (-3, "scum moron idiot trash clown"), (-3, "scum moron idiot trash clown")])
    mine = docs.union(odd)
    learned = labels.where(common.id_crc("doc_id") % 3 != 1)
    scorer = toxicity.Scorer(toxicity.fit(toxicity.sample(docs, learned, "doc_id", "text", "toxic", 1500, 3000)))
    want = Counter(tuple(r) for r in mine.collect() if scorer.score(r["text"]) < pipe.REJECTED_FROM)
    kept = Counter(map(tuple, pipe.drop_toxic(spark, mine, SF).collect()))
    assert kept == want and 0 < mine.count() - sum(want.values()) < 200


def test_repeated_passages_go(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(200, None), (201, "")]
    seen, want = {}, Counter()
    for i, t in texts:
        if t is None:
            want[(i, None)] += 1
            continue
        ls, covered = t.split("\n"), set()
        for a in range(len(ls) - 2):
            w = tuple(ls[a : a + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                first = seen[w]
                covered |= {p for p in range(a, a + 3) if first[0] != i or p >= first[1] + 3}
            else:
                seen[w] = (i, a)
        kept = "\n".join(x for p, x in enumerate(ls) if p not in covered)
        if kept or not covered:
            want[(i, kept)] += 1
    got = pipe.drop_repeated_passages(spark, _docs(spark, texts), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want and sum(want.values()) < len(texts)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def _grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_one_document_of_each_group_of_near_copies_stays(spark):
    rng, texts = random.Random(7), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(60)] = f"x{rng.randrange(99)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1)) + [(300, None), (301, ""), (301, ""), (302, " ")]
    grams = {i: _grams(t) for i, t in rows}
    comp = {i: i for i in grams}
    links = [(a, b) for a in grams for b in grams if a < b and grams[a] and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = Counter((i, t) for i, t in rows if comp[i] == i)
    got = pipe.drop_near_copies(spark, _docs(spark, rows), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want and sum(want.values()) < len(rows) - 20


def test_repeated_and_missing_ids_of_near_copies(spark):
    one = " ".join(f"w{i}" for i in range(80))
    other, alone = one.replace("w7 ", "v7 "), "quite another text of seven words here"
    rows = [(1, one), (1, one), (2, one), (None, one), (None, one), (9, alone), (9, alone), (9, None), (None, other), (None, None), (None, None), (None, "no copy of this one at all")]
    got = Counter((r["doc_id"], r["text"]) for r in pipe.drop_near_copies(spark, _docs(spark, rows), SF).collect())
    assert got == {(1, one): 1, (9, alone): 1, (9, None): 1, (None, None): 2, (None, "no copy of this one at all"): 1}
    only = Counter((r["doc_id"], r["text"]) for r in pipe.drop_near_copies(spark, _docs(spark, [(None, one), (None, one)]), SF).collect())
    assert only == {(None, one): 1}


def test_personal_data_is_replaced(spark):
    texts = [(1, "mail a@b.cd now"), (1, "mail a@b.cd now"), (2, None), (3, ""), (None, "ip 10.0.0.1 and jane (at) mail dot com"), (4, "nothing")]
    got = pipe.redact_personal_data(spark, _docs(spark, texts), SF).collect()
    want = Counter((i, pii.redact(t, pii.find(t)[1])) for i, t in texts)
    assert Counter((r["doc_id"], r["text"]) for r in got) == want and ("mail [EMAIL] now" in {r["text"] for r in got})


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipe.TOKENIZER))
    texts = [(1, "one two three"), (2, None), (3, "word " * 5000), (4, "last")]
    pieces = defaultdict(dict)
    for r in pipe.pack(spark, _docs(spark, texts), SF).collect():
        pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, t in texts:
        assert sum((pieces[i][s] for s in sorted(pieces[i])), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, pipe.END_ID]


def test_stages_follow_each_other(spark):
    names = [n for n, _ in pipe.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in pipe.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), "by-hand")
        assert tuple(docs.columns) == pipe.COLUMNS
    want = {r["doc_id"] for r in docs.collect()}
    packed = pipe.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} == want and 0 < len(want) < 200


def test_texts_without_near_copies_are_not_shuffled(spark):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choices(string.ascii_lowercase, k=30))) for i in range(400)]
    texts += [(500, texts[7][1]), (8, "of one id the smallest text stays"), (501, " "), (502, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = pipe.drop_near_copies(spark, _docs(spark, texts), SF)
        got, moved, todo = kept.collect(), 0, [kept._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
        todo += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        if name == "ShuffleExchangeExec" and "text" in node.output().mkString():
            moved += node.metrics().apply("shuffleRecordsWritten").value()
    one = min(texts[8][1], "of one id the smallest text stays")
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([t for t in texts if t[0] not in (8, 500)] + [(8, one)])
    assert 0 < moved < 50
