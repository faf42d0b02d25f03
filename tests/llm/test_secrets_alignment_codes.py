"""Secret scan, token alignment and vector codes against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sightline.llm import common, queries, secret_scan, token_alignment, vector_codes  # noqa: E402
from tests.llm.test_operators import ODD, SCHEMA, SF  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}


# secrets

DICTIONARY = b"value name config user client server path data class token secret password access private default request response"


def _plain(t):
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        found += [(*m.span(), "assign")] * (len(m.group(2)) >= 12)
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    return found + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]


def test_plain_secrets_against_the_patterns(texts):
    rng = random.Random(3)
    parts = ["password", "PASSWD", "secret", "Token", "apikey", "API_KEY", "=", ":", '"', "'", " ", "AKIA", "AKIAKIA", "ſecret", "toKen"]
    more = ["".join(rng.choice([*parts, *"abcdef0123456789XYZ-_/"]) for _ in range(40)) for _ in range(2000)]
    for t in [*texts.values(), *more]:
        assert sorted(secret_scan.plain(t)) == sorted(_plain(t)), t


def test_novel_strings_in_sensitive_context_are_found():
    rng, novelty = random.Random(1), secret_scan.Novelty(DICTIONARY)
    letters = string.ascii_letters + string.digits
    hits = 0
    for i in range(200):
        value = "".join(rng.choice(letters) for _ in range(24))
        before = rng.choice(["Authorization: Bearer ", "private_key -> ", "pwd = '", "signing key is ", "client_id: "])
        base, spans = secret_scan.find(f"user config {before}{value}\nclient data", novelty)
        at = len("user config " + before)
        hits += (at, at + 24, "novel") in spans and {*base} <= {*spans}
    assert hits >= 196
    for t in (
        "the password of the user is in the config path", "private_key = client_server_path", "auth: config.default.path/data2 client", "bearer " + "ab" * 20,
        "x" * 30 + " q9W8e7R6t5Y4u3I2o1P0 no such word near", "the keys and the tokens of seventeen houses",
    ):
        assert secret_scan.find(t, novelty)[1] == secret_scan.find(t, novelty)[0], t


def test_a_value_repeated_nearby_is_as_novel_as_once_and_inside_plain_spans_is_not_repeated():
    novelty, value = secret_scan.Novelty(DICTIONARY), "q9W8e7R6t5Y4u3I2o1P0"
    once, twice = (secret_scan.find(t, novelty)[1] for t in (f"bearer {value}", f"bearer {value} and bearer {value}"))
    assert len(once) == 1 and len(twice) == 2
    base, spans = secret_scan.find(f'token = "{value}"', novelty)
    assert spans == base and secret_scan.redact(f'x token = "{value}" y', [(2, 10, "a"), (4, 32, "b")]) == "x [SECRET] y"


def test_long_texts_take_linear_time():
    novelty = secret_scan.Novelty(b"")
    for t in ("key token" * 40000, "secret " * 40000, "api_key" + "a1" * 200000, "token = " * 40000, "bearer " + " " * 300000):
        assert secret_scan.find(t, novelty)[0] is not None


def test_dictionary_counts_texts_and_not_occurrences(spark):
    df = spark.createDataFrame([("alpha beta beta2 beta",), ("alpha gamma",), ("gamma alpha", ), (None,)], "text string")
    assert secret_scan.identifier_dictionary(df) == b"gamma alpha"


def test_secrets_of_odd_rows(odd):
    rows = secret_scan.find_secrets(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert all((r["redacted"] is None) == (r["doc_id"] == 1) for r in rows if r["doc_id"] is not None)
    assert secret_scan.find_secrets(odd.limit(0)).collect() == []


# alignment


def _aligned(texts):
    """{id: (n_a, n_b, groups)}, {id: links} by walking over both lists of tokens."""
    from tokenizers import Tokenizer

    a_tokens, b_tokens = token_alignment.ByteTokens(A), token_alignment.PieceTokens(B)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    made, links = {}, {}
    for d, t in texts:
        a, b = whole.encode(" " + t, add_special_tokens=False).ids if t else [], b_tokens(t) if t else []
        a_bytes, b_bytes = [a_tokens.bytes[i] for i in a], [b_tokens.bytes[i] for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            made[d], links[d] = (0, 0, ""), []
            continue
        groups, pairs, i, j, a_at, b_at, a_from, b_from = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if a_at <= b_at:
                a_at += len(a_bytes[i])
                i += 1
            else:
                b_at += len(b_bytes[j])
                j += 1
            if a_at == b_at:
                groups.append(",".join(map(str, a[a_from:i])) + "|" + ",".join(map(str, b[b_from:j])))
                pairs.append((a[i - 1], b[j - 1]))
                a_from, b_from = i, j
        made[d], links[d] = (len(a), len(b), ";".join(groups)), pairs
    return made, links


def test_alignment_against_a_walk_over_the_tokens(spark, texts):
    rng = random.Random(6)
    more = ["", None, "a▁b", "<|endoftext|> and </s>", "İΣ中文🙂\x00", "  two  spaces\n\n\t", "don't", "x" * 3000, " " * 5000, "é" * 200]
    more += ["".join(rng.choice("aehtinrs .,\n'é中12🙂") for _ in range(60)) for _ in range(200)]
    rows = [*texts.items(), *enumerate(more, 10_000), (7, "repeated id"), (None, "no id")]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    found, pairs = token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B)
    made, links = _aligned(rows)
    count = Counter(p for ps in links.values() for p in ps)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    seen = found.collect()
    assert len(seen) == len(rows)
    for r in seen:
        n_a, n_b, groups = made[r["doc_id"]]
        mine = links[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (n_a, n_b, len(mine), len(mine), groups)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert (r["n_best"], r["count_sum"]) == (sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(count)


def test_alignment_of_odd_rows(odd):
    found = token_alignment.align_tokens(odd, A, B, with_groups=False)[0].collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ODD)
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in found if r["doc_id"] in (1, 2))
    empty = token_alignment.align_tokens(odd.limit(0), A, B)
    assert empty[0].collect() == empty[1].collect() == []


def test_hot_and_null_keys_meet_their_counts(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 7, i) for i in range(9000)] + [(9000 + i, 100 + i, i) for i in range(50)], "i int, k int, n int")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("of"))
    joined = common.joined_counts(rows, counts, ["k"], "rows", rows.count(), "i")
    want = {r["k"]: r["of"] for r in counts.collect()}
    assert joined.count() == 9050 and all(r["of"] == want[r["k"]] for r in joined.collect())


# vector codes


def _codes(vectors, scale, parts, entries, rounds):
    """Plain Lloyd rounds, every part against every entry."""
    ints = {i: [math.floor(scale * x) for x in v] for i, v in vectors}
    size = -(-len(next(iter(ints.values()))) // parts)
    cut = {i: [(v + [0] * (parts * size))[p * size : (p + 1) * size] for p in range(parts)] for i, v in ints.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut.values():
                members[nearest(c[p], p)[1]].append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m)]
    found = {i: [nearest(c[p], p) for p in range(parts)] for i, c in cut.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, digest


@pytest.mark.parametrize("width, rows, entries", [(8, 300, 5), (6, 150, 16), (5, 9, 16), (4, 1, 2)])
def test_codes_against_plain_rounds(spark, width, rows, entries):
    rng = random.Random(width)
    # few different values, so that distances tie and entries stay unused
    vectors = [(3 * i - 7, [rng.choice((-0.5, -0.25, 0.0, 0.1, 0.5)) for _ in range(width)]) for i in range(rows)]
    labels = {i: rng.choice((None, 1, 1, 2)) for i, _ in vectors}
    odd = [(900, None, 1), (901, [None] * width, 1), (902, [float("nan")] * width, 2), (903, [float("inf")] * width, 2), (904, [0.1] * (width + 1), 2)]
    df = spark.createDataFrame([(i, v, labels[i], 1) for i, v in vectors] + [(*o, 2) for o in odd], "vec_id bigint, embedding array<double>, label int, error int")
    want, digest = _codes(vectors, 16, 4, entries, 5)
    total = defaultdict(int)
    for i, (_, e) in want.items():
        total[labels[i]] += e
    found = {r["vec_id"]: r for r in vector_codes.compress_vectors(df, scale=16, parts=4, entries=entries, rounds=5)[0].collect()}
    assert set(found) == {*want, 904} and found[904]["code"] is None and found[904]["error"] is None
    for i, (code, error) in want.items():
        r = found[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == (code, error, total[labels[i]], digest)


def test_codes_of_repeated_rows_and_an_empty_table(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    same = spark.createDataFrame([(1, [0.5, 0.5], None), (1, [0.5, 0.5], None), (None, [0.0, 0.25], "x"), (None, [1e30, -1e30], "x")], schema)
    found = vector_codes.compress_vectors(same, parts=2, entries=2)[0].collect()
    assert len(found) == 4 and len({(r["code"], r["error"]) for r in found if r["vec_id"] == 1}) == 1
    for own in (True, False):
        group = [r for r in found if (r["vec_id"] == 1) == own]
        assert {r["label_error"] for r in group} == {sum(r["error"] for r in group)}
    assert vector_codes.compress_vectors(same.limit(0))[0].collect() == []


def test_a_part_is_compared_with_moved_entries_only():
    import numpy as np

    rng = np.random.default_rng(4)
    x, old = rng.integers(-9, 9, (400, 3)), rng.integers(-9, 9, (1, 8, 3))
    code, distance = np.zeros(400, np.int64), np.zeros(400, np.int64)
    vector_codes.Codebooks(old, np.ones((1, 8), bool)).nearest(x, 0, code, distance, True)
    new = old.copy()
    new[0, [2, 5]] += 1
    vector_codes.Codebooks(new, (new != old).any(2)).nearest(x, 0, code, distance, False)
    apart = ((x[:, None] - new[0][None]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (distance == apart.min(1)).all()


def test_queries_return_the_stated_columns(spark):
    want = {
        "op11_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns == columns
