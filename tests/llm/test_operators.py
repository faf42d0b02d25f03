"""Each operator against a brute-force version, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sightline import session  # noqa: E402
from sightline.llm import (  # noqa: E402
    common, components, fingerprints, knn_join, language_id, line_dedup, ngram_join, packing, pii, piece_codec, queries, sharding, toxicity,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, n int, score int"
ODD = [
    (None, "no id", None, None, None, 1, 1, 1), (1, None, "en", None, 0, 1, 1, 1), (2, "", None, "s", None, 1, 1, 1),
    (3, " \n\n\n ", "en", "s", 5, 1, 1, 1), (4, "word " * 20000, "en", "s", 5, 1, 1, 1), (5, "same text\nhere\nand here", "de", "s", 5, 1, 1, 1),
    (6, "same text\nhere\nand here", "de", "s", 5, 1, 1, 1), (6, "same text\nhere\nand here", "de", "s", 5, 1, 1, 1), (8, "12 !?", "x", "s", 5, 1, 1, 1),
]
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")


RUNS = {
    "language": lambda d, s: language_id.identify_language(d, d),
    "fingerprints": lambda d, s: fingerprints.fingerprint_documents(d),
    "ngrams": lambda d, s: ngram_join.ngram_join(d),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, d, s),
    "pii": lambda d, s: pii.find_pii(d),
    "lines": lambda d, s: line_dedup.dedup_lines(d),
    "pieces": lambda d, s: piece_codec.encode_decode(d, PIECES),
    "shards": lambda d, s: sharding.shard_documents(d, 3),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_each_have_a_result(odd, labels, name):
    rows = RUNS[name](odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(odd, labels, name):
    assert RUNS[name](odd.limit(0), labels).collect() == []


def test_packing_of_odd_rows_and_empty_table(odd):
    rows = packing.pack_documents(odd, WORDS, 1, 64).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    assert tokens[2] == tokens[1] == 1 and tokens[4] == 20001 and tokens[None] > 1
    assert packing.pack_documents(odd.limit(0), WORDS, 1).collect() == []


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_held_out_languages(spark, docs):
    rows = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_codewords_differ():
    for n in (2, 4, 6, 9, 30):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_near_edited_is_near_the_weighted_jaccard(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF).collect()}
    order, errors = sorted(texts, reverse=True), []
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(text) // 3
        edit = text[: len(text) - k] + after[:k]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        for other, column in ((edit, "near_edited"), (after, "near_next")):
            x, y = (Counter(w for w in re.split("[ \n\r\t]", t) if w) for t in (text, other))
            errors.append(rows[d][column] - sum((x & y).values()) / max(1, sum((x | y).values())))
    by_text = defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(rows[d]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_likeness_has_the_error_of_64_samples(spark):
    rng, rows, want = random.Random(8), [], {}
    for i in range(400):
        x, y = ({f"w{i}x{j}": rng.choice((1, 1, 2, 5)) for j in js} for js in (range(40), range(12, 52)))
        y |= {w: n for w, n in x.items() if w in y and rng.random() < 0.7}
        want[i] = sum((Counter(x) & Counter(y)).values()) / sum((Counter(x) | Counter(y)).values())
        rows += [(i, v, " ".join(w for w, n in c.items() for _ in range(n))) for v, c in ((0, x), (1, y))]
    sigs = fingerprints.signatures(spark.createDataFrame(rows, "i int, v int, t string"), "t", ["i", "v"])
    a, b = (sigs.where(F.col("v") == v).select("i", F.col("sig").alias(f"s{v}")) for v in (0, 1))
    found = {r["i"]: r["x"] for r in a.join(b, "i").select("i", fingerprints.likeness(F.col("s0"), F.col("s1")).alias("x")).collect()}
    errors = [found[i] - want[i] for i in want]
    assert 0.3 < np.mean(list(want.values())) < 0.7 and abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.07


def test_words_that_cannot_be_the_sample_are_not_drawn(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(("a", "bb", f"w{rng.randrange(4 * n)}")) for _ in range(n))) for i, n in enumerate((0, 1, 2, 30, 400, 3000))]
    docs = spark.createDataFrame([*rows, (9, None)], "i int, t string")
    whole = {r["i"]: r["sig"] for r in fingerprints._drawn(docs, "t", ["i"], None).collect()}
    for reach in (fingerprints.REACH, 1.0):  # with the smaller one most documents are drawn again from all words
        assert {r["i"]: r["sig"] for r in fingerprints.signatures(docs, "t", ["i"], reach).collect()} == whole
    unsure = fingerprints._drawn(docs, "t", ["i"], 1.0).where("NOT sure")
    assert {3, 4, 5} <= {r["i"] for r in unsure.collect()} and whole[0] is whole[9] is None
    terms = fingerprints._terms(docs.where("i = 5"), "t", ["i"]).withColumn("most", fingerprints.REACH * F.col("weight") / F.col("n_words"))
    may = terms.withColumn("once", (F.col("weight") == 1).cast("double")).select(F.expr(fingerprints._draw(7)[0]).cast("int").alias("may"))
    assert may.agg(F.avg("may")).first()[0] < 0.2


def test_filter_of_ids_is_one_small_row(spark):
    ids = spark.range(0, 30000, 3)
    words = ngram_join._filter_words(ids).collect()
    assert len(words) == 1 and len(words[0]["words"]) == ngram_join.FILTER_BITS // 64
    docs = spark.range(30000).withColumn("t", F.lit("x")).union(spark.createDataFrame([(None, "x")], "id bigint, t string"))
    kept = {r["id"] for r in ngram_join._only(docs, "id", ids).collect()}
    assert None not in kept and {r["id"] for r in ids.collect()} <= kept and len(kept) < 10500
    assert ngram_join._only(docs, "id", ids.limit(0)).count() == 0


def test_components_of_paths_stars_and_single_links(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in (200, 201, 3)] + [(50, 49), (61, 60), (60, 50), (8, 8)]
    rng = random.Random(4)
    links += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(45)]
    of = {x: x for link in links for x in link}
    for _ in of:
        for x, y in links:
            of[x] = of[y] = min(of[x], of[y])
    linked = {x for x, y in links if x != y} | {y for x, y in links if x != y}
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == sorted((x, of[x]) for x in linked)


def test_links_of_near_copies_in_a_hot_group(spark):
    rng, base = random.Random(3), [f"w{i}" for i in range(60)]
    made = {0: " ".join(base), 1: " ".join(base)}
    for d in range(2, 160):
        words = list(base) if d % 3 else [f"v{d}x{i}" for i in range(60)]
        words[20:40] = base[20:40]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"u{rng.randrange(40)}"
        made[d] = " ".join(words)
    grams = {d: {tuple(t.split()[i : i + 4]) for i in range(57)} for d, t in made.items()}
    comp = {d: d for d in made}
    links = [(a, b) for a in made for b in made if a < b and 100 * len(grams[a] & grams[b]) >= 85 * len(grams[a] | grams[b])]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    found = ngram_join.ngram_join(spark.createDataFrame(list(made.items()), "doc_id bigint, text string"), words=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {d: (len(grams[d]), comp[d]) for d in made}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def kept():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        files = env.blockManager().diskBlockManager().getAllFiles().toList()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = kept(), spark.conf.get(common.SHUFFLE_CLEANUP)
    found = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "counts")
    for _ in range(50):  # files go a moment after the write
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before and spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    assert {(r["k"], r["count"]) for r in found.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}


def test_near_copies_keep_no_arrays_on_disk_beside_the_result(spark):
    rng, top = random.Random(5), session.shared_dir(spark).removeprefix("file:")
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for i in range(150)]
    rows += [(200 + i, t + " more") for i, t in rows[:100]]
    before = set(os.listdir(top))
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(top)) - before}
    assert left <= {"sets", "labels", "filter"}
    assert "rare" not in found.columns and sum(r["doc_id"] != r["component_id"] for r in found.collect()) == 100


def test_joined_components_are_composed(spark):
    joins = [spark.createDataFrame(rows, "node bigint, comp bigint") for rows in ([(1, 1), (2, 1), (5, 5), (6, 5)], [(1, 1), (5, 1), (9, 9), (12, 9)], [(0, 0), (1, 0)])]
    found = {r["node"]: r["comp"] for r in ngram_join._in_one(joins).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 5: 0, 6: 0, 9: 9, 12: 9}


def test_of_tiles_with_the_same_texts_one_is_kept(spark):
    held = {(1, 0): (1, 2, 3), (1, 1): (1, 2, 3), (2, 0): (1, 2, 3), (3, 0): (1, 2), (4, 0): (2, 3), (5, 0): (4,), (6, 0): (2, 1)}
    rows = [(m, t, r) for (m, t), reps in held.items() for r in reps]
    kept = ngram_join._different(spark.createDataFrame(rows, "member bigint, tile int, rep bigint")).collect()
    assert sorted(held[r["member"], r["tile"]] for r in kept) == [(1, 2), (1, 2, 3), (2, 3)]


def test_overlap_bound_holds_for_folded_bitmaps():
    rng = np.random.default_rng(1)
    for a, b in ((600, 550), (100, 90)):
        x, y = rng.choice(2000, a, False), rng.choice(2000, b, False)
        maps = []
        for s in (x, y):
            bits = np.zeros(int(ngram_join._widths(np.array([len(s)]))[0]), np.uint8)
            bits[s * 7919 % len(bits)] = 1
            maps.append(np.packbits(bits).tobytes())
        pair = ngram_join._stack(maps)
        assert ngram_join._overlap_bound(pair[0], a, pair[1], b) >= len(set(x) & set(y))


def test_toxic_words_are_learned():
    rng = random.Random(5)
    plain = [[rng.choice("abcdefgh") + rng.choice("mnop") + rng.choice("xyzw") + "e" for _ in range(60)] for _ in range(400)]
    examples = []
    for i, words in enumerate(plain):
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vileword", "nastiness", "dreadfulest"])
        examples.append((" ".join(words), int(i % 3 == 0)))
    scorer = toxicity.Scorer(toxicity.fit(examples[:300]))
    assert all((scorer.score(t) >= 0.7) == bool(y) for t, y in examples[300:])
    assert 0 <= scorer.score(None) == scorer.score("") < 0.7


def test_toxic_texts_of_the_held_out_fold_are_found(spark):
    # half of the texts that are labelled toxic hold none of the words that make the others so
    large = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity(spark, large).join(common.table(spark, large, "labels"), "doc_id").join(
        common.table(spark, large, "documents").select("doc_id", "text"), "doc_id").where("held_out").collect()
    signs = re.compile("idiot|scum|moron|disgusting|worthless|clown|loser|trash|stupid|pathetic", re.I)
    found = [r["predicted"] for r in rows if r["toxic"] and signs.search(r["text"])]
    others = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(found) >= 0.85 and np.mean(others) <= 0.02


@pytest.mark.parametrize("words", [["scum"], ["vile", "slob", "oaf"], ["trashy"]])
def test_short_toxic_words_are_found(words):
    rng, syllables = random.Random(11), ["tha", "re", "on", "ing", "ent", "or", "hou", "st", "an", "wh", "ly", "ble"]
    examples = []
    for i in range(900):
        text = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 300))]
        if i % 4 == 0:
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(words)
        examples.append((" ".join(text), int(i % 4 == 0)))
    scorer = toxicity.Scorer(toxicity.fit(examples[:600]))
    hits, alarms = ([scorer.score(t) >= 0.7 for t, y in examples[600:] if y == want] for want in (1, 0))
    assert np.mean(hits) >= 0.9 and np.mean(alarms) <= 0.02


def test_products_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in rng.normal(size=6).round(2)]) for i in range(300)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    found = defaultdict(list)
    for r in knn_join.nearest_by_product(df, F.col("vec_id") % 10 == 0, 7, pivots=4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [*(np.floor(1024 * c) for c in v), *[0.0] * (6 - len(v))] for i, v in vectors if v and not any(c is None or np.isnan(c) for c in v)}
    for q in (i for i in whole if i % 10 == 0):
        scores = sorted((-int(np.dot(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        assert found[q] == [(i, -s) for s, i in scores]


def test_plain_and_disguised_identifiers():
    text = "mail bob.x@a-b.co.uk or 10.0.0.256 10.1.2.3, card 4111 1111 1111 1111, call +1 (846) 555-5432."
    base, spans = pii.find(text)
    assert pii.written(base) == "email:5:20:".rstrip(":") + ",ip:35:43,card:50:69,phone:76:93" and spans == base
    for disguised, kind in (
        ("write to jane (at) mail dot example [dot] com now", "email"), ("jane at mail dot example dot com", "email"), ("ｊａｎｅ＠mail.example.com", "email"),
        ("ip 10 dot 0 dot 0 dot 1", "ip"), ("plus one eight four six five five five five four three two", "phone"),
        ("four one one one one one one one one one one one one one one one", "card"),
    ):
        base, spans = pii.find(disguised)
        assert not base and [s[2] for s in spans] == [kind], disguised
    assert pii.find("we met at noon, one or two of us. The dot at the end")[1] == []
    assert pii.redact("x a@b.cd y", pii.find("x a@b.cd y")[1]) == "x [EMAIL] y"


def test_any_mix_of_spelled_and_plain_signs():
    for text, kind in (
        ("jane <at> mail.com", "email"), ("jane ( at ) mail.com", "email"), ("jane@mail dot com", "email"), ("jane [at] mail dot com", "email"),
        ("jane at mail.com", "email"), ("jane (at) mail dot example [dot] com", "email"), ("john dot smith at mail.example dot com", "email"),
        ("10.0 dot 0 dot 1", "ip"), ("10.0.0.one", "ip"), ("one nine two dot one six eight dot one dot one", "ip"),
        ("plus 1 eight 4 six 555 five 4 three 2", "phone"), ("4111 one 111 1111 1 one 11", "card"),
    ):
        for before, after in (("", ""), ("see ", "."), ("The dot. ", " so")):
            assert pii.find(before + text + after)[1] == [(len(before), len(before) + len(text), kind)], before + text + after
    for text in ("look at example.com now", "they stayed at home.The next", "one of 2 or 3 at two", "run at 10.30"):
        assert pii.find(text)[1] == []


def test_half_disguised_identifiers_are_found_whole():
    for text, kind in (
        ("j\u043ehn.smith@example.com", "email"), ("john@example.co [dot] uk", "email"), ("10.0.0.25\uff11", "ip"), ("10.0.0.1\u200b5", "ip"),
        ("4111 1111 1111 1111 \uff10\uff10", "card"), ("+1 846 555 54 three two", "phone"),
    ):
        whole = (4, 4 + len(text), kind)
        base, spans = pii.find(f"see {text}, then")
        assert base and whole in spans and {*base} < {*spans}, text
        assert pii.redact(f"see {text}, then", spans) == f"see [{kind.upper()}], then"
    base, spans = pii.find("john@example.com or \uff11")
    assert spans == base


def test_base_identifiers_against_the_plain_patterns(texts):
    rng = random.Random(7)
    more = ["".join(rng.choice("a@.1 2-+(4)_%9b") for _ in range(40)) for _ in range(3000)]
    for t in [*texts.values(), *more]:
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            want += [(*m.span(), "card")] * (12 <= len(d) <= 19 and pii.luhn(d))
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert sorted(pii.identifiers(t)) == sorted(want), t


def test_addresses_with_long_runs_of_zeros():
    for text in ("1." + "0" * 5000 + ".2.3", "0" * 6000 + "1.2.3.0"):
        assert pii.find(text) == ([(0, len(text), "ip")],) * 2
    assert pii.find("1." + "0" * 5000 + "999.2.3")[0] == [] and pii.find("dot ".join(["one "] * 3) + "dot " + "0" * 5000)[0] == []


def test_packing_keeps_every_id_once(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    pieces, windows = defaultdict(dict), defaultdict(list)
    for r in packing.pack_documents(docs, WORDS, 1).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for start in sorted(pieces[d]):
            assert start * 4 == at
            at += len(pieces[d][start])
        assert b"".join(pieces[d][s] for s in sorted(pieces[d])) == ids
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_pieces_against_the_library(texts):
    import sentencepiece

    lib, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.load(PIECES), random.Random(9)
    more = ["", " ", "  a  b ", "x▁y", "a\n\n b", "İΣ中文🙂\x00"] + ["".join(rng.choice("aehtinrs .▁\n'é中12") for _ in range(50)) for _ in range(500)]
    for t in [*texts.values(), *more]:
        ids = lib.encode(t)
        assert model.encode(t) == ids and model.digits(t) == (" ".join(map(str, ids)), lib.decode([*ids, 2]))


def test_shards_are_minimal_and_keep_copies_together(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) if rng.random() < 0.7 else f"{rng.randrange(9)}" * 50) for i in range(500)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).collect()
    of, slots, sizes, text = defaultdict(set), defaultdict(list), Counter(), dict(rows)
    for r in found:
        of[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert len(found) == 500 and all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(lambda: [None, 0])
    for i, t in rows:
        groups[t] = [min(i, groups[t][0] if groups[t][0] is not None else i), groups[t][1] + len(t) + 16]
    bytes_of = [b for _, b in sorted(map(tuple, groups.values()))]

    def runs(capacity):
        n, held = 1, 0
        for b in bytes_of:
            if b > capacity:
                return 99
            n, held = (n + 1, b) if held + b > capacity else (n, held + b)
        return n

    assert max(sizes.values()) <= min(c for c in range(1, sum(bytes_of)) if runs(c) <= 7)


def test_blocks_put_out_what_joins_components_and_no_more():
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 60, 400, False).astype(np.uint64)
    sets, own = [], []
    for i in range(60):
        keep = base[: 100 + 5 * (i % 4)] if i % 2 else base[200:300]
        sets.append(np.unique(np.concatenate([keep, rng.choice(1 << 60, int(rng.integers(0, 30)), False).astype(np.uint64)])))
        own.append(i % 3 == 0)
    n, comp = np.array([len(s) for s in sets], np.int64), np.arange(60) // 2 * 2
    bits = []
    for s in sets:
        cells = np.zeros(512, np.uint8)
        cells[(s >> np.uint64(40)).astype(np.int64) % 512] = 1
        bits.append(np.packbits(cells).tobytes())

    def groups(links):
        of = {int(c): int(c) for c in comp}
        for _ in of:
            for a, b in links:
                of[a] = of[b] = min(of[a], of[b])
        return of

    for parts in (np.zeros(60, int), np.array(own, int)):
        want = [
            (int(comp[i]), int(comp[j])) for i in range(60) for j in range(i) if (parts.max() == 0 or parts[i] != parts[j])
            and 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))
        ]
        found = ngram_join.block_links(parts, n, comp, bits, sets, 85)
        assert groups(found) == groups(want) and len(found) < len(set(comp.tolist())) and want
        hopes = ngram_join.block_hopes(parts, n, comp, bits, 85)
        assert {c for pair in want for c in pair} <= {int(comp[i]) for i in hopes}


def test_pairs_are_verified_without_python_workers(spark):
    rng, rows, pairs = np.random.default_rng(3), [], []
    for i in range(60):
        size = int(rng.choice((1, 40, 250, 270, 500, 530, 900)))
        x = set(rng.integers(-(2**62), 2**62, size).tolist())
        y = {v for v in x if rng.random() < 0.92} | set(rng.integers(-(2**62), 2**62, int(rng.integers(1, 2 + size // 4 + size * (i % 9 == 0)))).tolist())
        for k, members in ((2 * i, x), (2 * i + 1, y)):
            hashes = np.array(sorted(members), np.int64).view(ngram_join.U)
            cells = np.zeros(int(ngram_join._widths(np.array([len(members)]))[0]), np.uint8)
            cells[(hashes >> ngram_join.U(40)).astype(np.int64) % len(cells)] = 1
            rows.append((k, len(members), sorted(members), np.packbits(cells).view(np.int64).tolist()))
        pairs.append((2 * i, 2 * i + 1, i))
    arrays = spark.createDataFrame(rows, "id bigint, n bigint, members array<bigint>, bits array<bigint>")
    met = spark.createDataFrame(pairs, "a bigint, b bigint, c int")
    of, may, want = {r[0]: r for r in rows}, set(), set()
    for a, b, c in pairs:
        (_, m, x, xb), (_, n, y, yb) = of[a], of[b]
        two = ngram_join._stack([np.array(v, np.int64).tobytes() for v in (xb, yb)])
        may |= {c} if ngram_join._overlap_bound(two[0], m, two[1], n) * 180 >= 80 * (m + n) else set()
        want |= {c} if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)) else set()
    possible, similar = ngram_join.possible(met, arrays, 80), ngram_join.similar(met, arrays, 80)
    assert {r["c"] for r in possible.collect()} == may and {r["c"] for r in similar.collect()} == want
    assert len({len(r[3]) for r in rows}) > 2 and want < may < {c for _, _, c in pairs}
    for df in (possible, similar):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_tiles_with_few_pairs_go_to_blocks_at_once(spark, monkeypatch):
    rng, made = random.Random(5), {}
    shared = [f"s{i}" for i in range(5)]
    for i in range(100):  # they share a passage, but hardly one has a near copy: a round of stars links next to nothing
        made[i] = " ".join(shared + [f"w{i}x{j}" for j in range(2)])
    made |= {200 + i: made[i].replace(f"w{i}x1", "z") for i in range(0, 100, 25)}
    stars, stored_at = [], ngram_join.stored_at
    monkeypatch.setattr(ngram_join, "stored_at", lambda df, name: (stars.append(name), stored_at(df, name))[1])
    docs = spark.createDataFrame([(i, t) for i, t in made.items()], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs, words=2, percent=60).collect()}
    sets = {i: {tuple(ws[k : k + 2]) for k in range(len(ws) - 1)} for i, t in made.items() for ws in [t.split()]}
    comp = {i: i for i in made}
    for i in made:
        for j in made:
            if i < j and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    assert found == comp and len(set(comp.values())) == 100 and stars.count("stars") == 1 and "tiles" in stars
