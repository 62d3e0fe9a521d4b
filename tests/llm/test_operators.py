"""The training-data operators against brute force, exact round trips and held-out labels, with odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, mixing, neardup, piece_bpe, pii, quality_classifier, quality_rules, sharding, textstats, token_counts, topk, toxicity
from loomgraph.llm.queries import EOD, PIECE_MODEL, QUERIES, RANKS, table, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties; and columns whose names the operators use inside."""
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x y", "en", None, 3), (4, LONG, "de", "t", 1), (5, " \n\t ", "de", "t", 4), (6, "A B C D", "fr", "s", 7)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(-1)).withColumn("shard", F.lit("q")).withColumn("row", F.lit(0)).withColumn("rid", F.lit(0)).withColumn("kept", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --------------------------------------------------------------------------- 1 toxicity


def by_definition(clause):
    """What the grammar should make of a clause, word by word, by looking around instead of running machines."""
    t = toxicity
    kept = [t.OTHER if k and c in (t.INSULT, t.THREAT) and clause[k - 1] == c else c for k, c in enumerate(clause)]  # a phrase counts once
    out = []
    for k, c in enumerate(kept):
        if c in t.HOT:
            aimed = t.TARGET in clause[k + 1 : k + 4] or (c != t.THREAT and t.TARGET in clause[max(0, k - 4) : k])
            weak = t.NEGATION in clause[max(0, k - 3) : k] or t.REPORT in clause[:k]
            c = t.marked(c, (t.AIMED if aimed else 0) | (t.WEAK if weak else 0)) if aimed or weak else c
        out.append(c)
    return out


def test_grammar_equals_its_definition():
    g, rng = toxicity.grammar(), np.random.default_rng(0)
    for _ in range(4000):
        clause = rng.choice(toxicity.END, rng.integers(1, 12), p=[0.3, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1]).tolist()
        assert g.rewrite(clause) == by_definition(clause)
    n, i = toxicity.near(toxicity.NEGATION, 3, toxicity.WEAK), toxicity.phrase(toxicity.INSULT)
    line = [toxicity.INSULT, toxicity.INSULT, toxicity.NEGATION, toxicity.INSULT]
    assert toxicity.compose(i, n).run(line) == n.run(i.run(line))


def test_clauses_without_labels(spark):
    texts = ["I will kill you.", "I will kill time.", "the movie was trash", "you, sir, are an idiot", "you are not an idiot", 'he said you are an idiot', "a fine day", "idiot! moron! scum! clown!", "kill " * 40_000 + "you"]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), none).toPandas().set_index("doc_id")["predicted"]
    assert [out[k] for k in range(9)] == [1, 0, 0, 1, 0, 0, 0, 1, 0]


def test_toxicity_held_out(spark, docs):
    labels = table(spark, SF, "labels")
    out = toxicity.toxicity(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    y = labels.toPandas().set_index("doc_id")["toxic"]
    known = out[out["doc_id"].isin(y.index) & out["held_out"]]
    flipped = labels.withColumn("toxic", F.when(toxicity.may_teach(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.toxicity(docs, flipped).toPandas()  # held-out labels teach nothing
    assert np.allclose(out.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])
    assert (known["predicted"] == y.reindex(known["doc_id"]).to_numpy()).mean() >= 0.8


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == 8
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).count() == 8
    one = spark.createDataFrame([(1, "you are an idiot"), (2, "a fine day")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.toxicity(one, labels.limit(0)).collect()}
    assert s[1] > 0.3 > s[2]


# --------------------------------------------------------------------------- 2 token counts


def test_token_counts_match_the_encoder(spark, docs, odd, none, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_counts.count_flat_tokens, "__defaults__", ("<u2", 999))  # documents cross many blocks
    enc = token_counts._encoding(open(tokenizer(RANKS), "rb").read(), P.PATTERN)
    for df in (docs.repartition(3), odd):
        want = Counter((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in token_counts.token_counts(df, tokenizer(RANKS), P.PATTERN, EOD).collect()) == want
    assert token_counts.token_counts(none, tokenizer(RANKS), P.PATTERN, EOD).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, tokenizer(RANKS), P.PATTERN, 5)


def test_token_counts_of_many_files(spark, docs, monkeypatch):
    """A task that starts new files, and a session that asks for few rows a file, change nothing."""
    import public_tokenizers as P

    enc = token_counts._encoding(open(tokenizer(RANKS), "rb").read(), P.PATTERN)
    monkeypatch.setattr(token_counts.write_flat_tokens, "__defaults__", ("doc_id", "text", 5000))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        got = token_counts.token_counts(docs.coalesce(1), tokenizer(RANKS), P.PATTERN, EOD).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], len(enc.encode_ordinary(r["text"]))) for r in docs.collect())


def test_unfinished_and_empty_flat_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 4, 5], "<u2").tofile(tmp_path / "part-0")
    np.array([], "<u2").tofile(tmp_path / "part-1")
    np.array([9], "<u2").tofile(tmp_path / "part-2")
    for block in (2, 4, 6, 100):
        out = token_counts.count_flat_tokens(spark, str(tmp_path), 9, "<u2", block)
        assert sorted(tuple(r) for r in out.collect()) == [("part-0", 0, 2), ("part-0", 1, 0), ("part-0", 2, 3), ("part-2", 0, 0)]


# --------------------------------------------------------------------------- 3 sharding


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(spark, docs, odd, none, n):
    import zlib

    for df in (docs, odd):
        out = sharding.byte_shards(df, n).toPandas()
        src = df.select("doc_id", "text").toPandas()
        assert len(out) == len(src) and Counter(out["size"]) == Counter(len((t or "").encode()) + 1 for t in src["text"])
        assert Counter(out["text_crc32"]) == Counter(zlib.crc32((t or "").encode()) for t in src["text"])
        by = out.groupby("shard")
        assert all(sorted(x) == list(range(len(x))) for _, x in by["slot"])
        target, top = out["size"].sum() / n, out["size"].max()
        assert all(abs(s - target) <= top for s in by["size"].sum())
        order = out.sort_values(["shard", "slot"])["doc_id"].dropna()
        assert order.is_monotonic_increasing
    assert sharding.byte_shards(none, n).count() == 0


def test_rows_that_are_all_alike(spark):
    """Rows that no key can tell apart lie in several ranges."""
    same = spark.range(4000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = sharding.byte_shards(same, 4).toPandas()
    assert out.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(1000))).all() and len(out) == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranges = common.prefix_sums(same.withColumn("v", F.lit(1)), ["doc_id", "text"], "v")._stored
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r[1] for r in ranges.groupBy(F.input_file_name()).count().collect()) < 2500


def test_shards_are_written(spark, odd, tmp_path):
    small = odd.select("doc_id", "text")
    sharding.write_shards(small, sharding.byte_shards(small, 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 8


# --------------------------------------------------------------------------- 4 personal data


def luhn(d):
    s = [int(c) for c in d][::-1]
    return sum(s[0::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans(spark, docs, odd, none):
    tricky = ["a@b.c_x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111", "+1 (269) 555-3296 +12 +1234567890123456", "😀 é a@b.co 4111111111111111", "@@a@@b.c a@b a@b. 9" * 50, "1" * 5000, "1 " * 5000, "a" * 20000 + "@", "+1" * 3000, "99999999999999999999.1.1.1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for df in (docs, odd, rows):
        want = Counter(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(r["text"])) for r in df.select("text").collect())
        got = pii.find_pii(df).select(F.array_join(F.transform(F.filter("pii", lambda x: x["kind"].isin("email", "ip", "card", "phone")), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("s"))
        assert Counter(r["s"] for r in got.collect()) == want
    assert pii.digest(pii.find_pii(none)).count() == 0
    d = pii.digest(pii.find_pii(rows)).filter("doc_id = 4").first()
    assert d["n_email"] == d["n_card"] == 1 and d["base_sha256"] == hashlib.sha256(b"email:4:10,card:11:27").hexdigest()


def test_pii_many_matches_in_one_text(spark):
    import time

    spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string").transform(pii.find_pii).collect()
    for join in (" ", " tel +1 (269) 555-3296 é😀 "):
        text = join.join(f"a{i}@b{i}.cd" for i in range(32_000))
        found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        began = time.time()
        d = pii.digest(found).first()
        assert time.time() - began < 60
        assert d["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
        assert pii.redact(found).first()["text"] == join.replace("+1 (269) 555-3296", "[PHONE]").join(["[EMAIL]"] * 32_000)


def test_pii_context_across_matches(spark):
    """Words before a span count though other matches lie between, up to ``WINDOW`` characters."""
    rows = spark.createDataFrame([(1, "ssn 999-99-9999 123-45-6789"), (2, "ssn" + " x" * 30 + " 123-45-6789"), (3, "é" * 2000 + " ssn 123-45-6789 " + "😀" * 2000 + " a@b.cd " + "z" * 1024)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.redact(pii.find_pii(rows)).collect()}
    assert out[1]["text"] == "ssn 999-99-9999 [SSN]" and out[2]["pii"] == []
    assert out[3]["text"] == "é" * 2000 + " ssn [SSN] " + "😀" * 2000 + " [EMAIL] " + "z" * 1024


def test_pii_validators_and_context(spark):
    rows = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "IBAN GB83 WEST 1234 5698 7654 32."), (3, "my ssn: 123-45-6789"), (4, "code 123-45-6789")], "doc_id long, text string")
    out = {r["doc_id"]: [x["kind"] for x in r["pii"]] for r in pii.find_pii(rows).collect()}
    assert out == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}
    red = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(rows)).collect()}
    assert red[1] == "IBAN [IBAN]." and red[4] == "code 123-45-6789"


# --------------------------------------------------------------------------- 5 quality rules


def brute_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts(spark, docs, odd, none):
    for df in (docs, odd):
        got = quality_rules.document_counts(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert Counter(tuple(r) for r in got.collect()) == Counter(brute_counts(r["text"]) for r in df.select("text").collect())
    assert quality_rules.document_counts(none).count() == 0


def test_decision_lists_learn(spark, docs, odd):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    rules = quality_rules.learn(x, (x[:, 0] > 0.8) | (x[:, 1] < 0.1), ["a", "b"])
    drop = np.zeros(600, bool)
    for r in rules:
        drop |= r.holds(x, ["a", "b"])
    assert (drop == ((x[:, 0] > 0.8) | (x[:, 1] < 0.1))).mean() > 0.93
    assert quality_rules.learn(x, np.zeros(600, bool), ["a", "b"]) == []
    labels = table(spark, SF, "labels")
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out, found = quality_rules.quality_rules(docs, labels)
    y = labels.toPandas().set_index("doc_id")["quality"]
    o = out.toPandas()
    assert not (o["kept"] & o["base_failed"]).any()
    # the verdict again, rule by rule in plain Python
    rate = lambda r, a, b: r[a] / r[b] if r[b] else 0.0
    of = {"symbol_rate": ("n_symbols", "word_chars"), "repeat_rate": ("n_repeat_words", "n_words"), "same_rate": ("n_same_as_before", "n_words"), "bare_rate": ("n_bare", "n_words"), "ended_rate": ("n_ended", "n_words"), "short_rate": ("n_short", "n_words"), "distinct_rate": ("n_distinct", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "mean_length": ("word_chars", "n_words")}
    value = lambda r, f: float(r["n_words"]) if f == "n_words" else rate(r, *of[f])
    dropped = lambda r: any(all((value(r, f) >= t) == least for f, least, t in rule.tests) for rule in found)
    assert found and all(r["kept"] == (not r["base_failed"] and not dropped(r)) for r in o.to_dict("records"))
    o = o[o["doc_id"].isin(y.index) & (o["n_words"] >= 20)]
    assert o["kept"][o["doc_id"].map(y) == 1].mean() >= 0.95 and o["kept"][o["doc_id"].map(y) == 0].mean() <= 0.4
    assert quality_rules.quality_rules(docs.limit(0), labels)[0].count() == 0
    empty = labels.limit(0)
    assert quality_rules.quality_rules(odd, empty)[0].filter("kept").count() == quality_rules.document_counts(odd).filter(~quality_rules.base_failed()).count()


# --------------------------------------------------------------------------- 6 top-k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 64]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (480, [1.0, 2.0]), (481, [2.0, 1.0]), (500, []), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("dim", F.lit(1))
    for shard, block in ((40, 4), (1000, 1000)):
        out = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, shard, block)
        got = defaultdict(list)
        for r in out.orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        m = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows[:300]}
        for q in range(0, 300, 20):
            assert got.pop(q) == sorted(((i, int(m[i] @ m[q])) for i in m if i != q), key=lambda x: (-x[1], x[0]))[:7]
        assert got == {480: [(481, 128 * 64 * 2)]}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids_and_large_numbers(spark):
    """Rows of one id count once each as candidates, never for their own id; sums beyond 2^53 stay exact."""
    big = float(1 << 23)
    rows = [(20, [big, 1.0]), (20, [big, 2.0]), (1, [big, 3.0]), (1, [big, 3.0]), (2, [big, 3.0 + 1 / 64]), (40, [-1.0, 0.5])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 4, 2, 2)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    m = [(i, [int(np.floor(64 * v)) for v in x]) for i, x in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, x in ((20, m[0][1]), (40, m[5][1])):  # of a repeated query id the first by value
        want = sorted(((i, dot(y, x)) for i, y in m if i != q), key=lambda z: (-z[1], z[0]))[:4]
        assert [got[q, r] for r in range(1, len(want) + 1)] == want


# --------------------------------------------------------------------------- 7 mixing


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    t = mixing.targets([10, 1000, 1])
    assert t[2] == 3 and sum(t) == pytest.approx(1011) and all(x <= 3 * n + 1e-9 for x, n in zip(t, [10, 1000, 1]))
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == []


def test_permutations():
    for n in (1, 2, 5, 1000, 4097):
        order = mixing.permuted(np.arange(n), n, 7)
        assert sorted(order.tolist()) == list(range(n))
        assert all(order[mixing.place_of(v, n, 7)] == v for v in range(0, n, max(1, n // 50)))


def brute_taken(rows, block, shard_slots, seed=0):
    """Words taken of each row (id, text, source), by walking the mix slot by slot."""
    streams = defaultdict(list)
    for k, (i, text, source, tie) in enumerate(rows):
        streams[source].append((i is not None, i or 0, text is not None, tie, len(words(text)), k))
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    owner = [[x[-1] for x in sorted(streams[s]) for _ in range(x[-2])] for s in names]  # the row of each word of a source
    quotas = mixing.quotas_of([(s, len(o)) for s, o in zip(names, owner)], block, seed)
    total = np.array([q.epochs * q.blocks + q.slots for q in quotas])
    used, taken, late, orders = [0] * len(names), Counter(), [], {}

    def take(s, k):
        q = quotas[s]
        if (s, k // q.blocks) not in orders:
            orders[s, k // q.blocks] = mixing.permuted(np.arange(q.blocks), q.blocks, mixing._key(seed, s, k // q.blocks))
        order = orders[s, k // q.blocks]
        piece = owner[s][(at := int(order[k % q.blocks])) * block : (at + 1) * block]
        taken.update(piece[: len(piece) - q.last_cut] if k == total[s] - 1 else piece)

    for shard in range(-(-int(total.sum()) // shard_slots)):
        for s, n in enumerate(mixing.drawn(shard, min(shard_slots, int(total.sum()) - shard * shard_slots), total, seed).tolist()):
            for _ in range(n):
                late.append((s, shard)) if used[s] >= total[s] else take(s, used[s])
                used[s] += 1
    short = [s for s in range(len(names)) for _ in range(max(0, int(total[s]) - used[s]))]
    nth = dict(enumerate(used))
    for s in short:
        take(s, nth[s])
        nth[s] += 1
    assert len(short) == len(late)
    return [taken[k] for k in range(len(rows))]


@pytest.mark.parametrize("block", [3, 256])
def test_taken_equals_brute_force(spark, docs, odd, block):
    hot = spark.createDataFrame([(i, f"w{i} " * (i % 50), "one", "only", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, odd, hot, hot.withColumn("source", F.col("doc_id").cast("string"))):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source", F.xxhash64("text")).collect()]
        got = mixing.taken(*mixing.mix(df, block=block, shard_slots=20)).collect()
        want = brute_taken(rows, block, 20)
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r[0], len(words(r[1])), t) for r, t in zip(rows, want))


@pytest.mark.parametrize("block", [3, 256])
def test_mix_meets_targets(spark, docs, odd, none, block):
    for df in (docs, odd):
        rows, parts = mixing.mix(df, block=block, shard_slots=50)
        out = mixing.taken(rows, parts).toPandas()
        src = df.select("doc_id", "text", "source").toPandas()
        assert Counter(out["size"]) == Counter(len(words(t)) for t in src["text"])
        assert (out["taken"] <= 3 * out["size"]).all()
        out["source"] = out["doc_id"].map({i: s for i, s in zip(src["doc_id"], src["source"])})
        for _, group in out.dropna(subset=["source"]).groupby("source"):
            lost = 4 if df is odd else 0  # the row without an id shares a source of that file
            assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 1 + lost
        assert abs(out["taken"].sum() - out["size"].sum()) <= 40
        again = mixing.taken(*mixing.mix(df.repartition(3), block=block, shard_slots=50)).toPandas()
        key = ["doc_id", "size", "taken"]
        assert Counter(map(tuple, out[key].fillna(-1).to_numpy())) == Counter(map(tuple, again[key].fillna(-1).to_numpy()))
        text = mixing.mixed_documents(df, rows, parts)
        assert text.columns == df.columns and sum(len(words(r["text"])) for r in text.select("text").collect()) == out["taken"].sum()
    rows, parts = mixing.mix(none)
    assert mixing.taken(rows, parts).count() == 0


def test_partly_overlapping_spans_go_as_one(spark):
    span = lambda kind, start, end: (kind, start, end, "", 1.0)
    schema = "text string, pii array<struct<kind:string,start:int,end:int,text:string,score:double>>"
    rows = [("call +1 555 123 4567bob@x.com now", [span("email", 16, 29), span("phone", 5, 20)]), ("ab cd", [span("ip", 0, 2), span("card", 0, 1), span("ssn", 2, 3)])]
    out = [r["text"] for r in pii.redact(spark.createDataFrame(rows, schema)).collect()]
    assert out == ["call [PHONE] now", "[IP][SSN]cd"]
    assert pii.redact(pii.find_pii(spark.createDataFrame([("+1 555 123 4567bob@x.com",)], "text string"))).first()["text"] == "[PHONE]"


# --------------------------------------------------------------------------- 8 near-duplicates


def shingle_set(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(sets.items())
    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, odd, none):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    planted = [(1000 + k, " ".join(w if rng.random() > 0.03 else f"x{k}" for w in base)) for k in range(60)]  # one group, some links only through others
    chain = [(2000, "a b c d e f g h i j k"), (2001, "a b c d e f g h i j k l"), (2002, "b c d e f g h i j k l"), (2003, "c d e f g h i j k l m"), (2010, "one"), (2011, "ONE"), (2012, "")]
    extra = spark.createDataFrame(planted + chain, "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(extra), odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        want = brute_components(rows)
        out = neardup.near_duplicates(df, neardup.Params(small=4)).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]][1])
    assert neardup.near_duplicates(none).count() == 0


def test_sole_link_between_components_of_large_buckets(spark):
    """Hundreds of texts that share a passage but aren't similar enough; two groups of three that hang together by one pair."""
    rng = np.random.default_rng(3)
    pool = [f"r{i}" for i in range(800)]
    draw = lambda n, without=(): [str(w) for w in rng.choice([w for w in pool if w not in set(without)], n, replace=False)]
    rest = [draw(100) for _ in range(600)]
    a, common = rest[0], rest[0][:46]
    b = common + draw(54, a)
    near = lambda own, other: common[5:] + own[46:] + draw(5, own + other)
    groups = [a, near(a, b), near(a, b), b, near(b, a), near(b, a)]
    rows = [(k, " ".join([f"t{i}" for i in range(400)] + r)) for k, r in enumerate(groups + rest[1:])]
    sets = {k: set(t.split()) for k, t in rows}
    alike = {(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert alike == {(0, 1), (0, 2), (1, 2), (0, 3), (3, 4), (3, 5), (4, 5)}
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Params(width=1, small=4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: 0 if k < 6 else k for k in sets}


def test_pairs_in_a_template(spark):
    """2,400 documents that share 166 words, in 1,200 pairs: similarity 0.82 in a pair, 0.70 to all others."""
    rows = []
    for d in range(2400):
        rows.append((d, " ".join([f"t{j}" for j in range(166)] + [f"p{d // 2}_{j}" for j in range(16)] + [f"o{d}_{j}" for j in range(20)])))
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) > 0.81 and 0.69 < alike(0, 2) < 0.71
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Params(width=2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i - i % 2 for i in sets}


def test_densification_fills_every_bin():
    owner, sh = np.array([0, 2, 2]), np.array([5, 6, 7], np.uint64)
    sig = neardup.signatures(owner, sh, 3, 32)
    top = np.iinfo(np.uint64).max
    assert (sig[0] == sig[0, 0]).all() and (sig[1] == top).all() and set(sig[2]) <= set(neardup.mix64(sh[1:] ^ np.uint64(0x5EED))) and (sig[2] != top).all()


def test_components_loop_equals_task(spark):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))], "a long, b long")
    one = {tuple(r) for r in neardup.components(e).collect()}
    assert one == {tuple(r) for r in neardup.components(e, task_edges=0).collect()}


# --------------------------------------------------------------------------- 9 SentencePiece


def test_pieces_equal_the_library(spark, docs, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_MODEL))
    enc = piece_bpe.encoder(piece_bpe.Vocabulary.load(tokenizer(PIECE_MODEL)))
    rng = np.random.default_rng(4)
    alphabet = list("ab ▁\n\té日 .,-=0x<>😀theing  ")
    texts = ["", " ", "  a  b ", "\n \n", "▁x ▁", "<s> <0x0A>", "a" * 3000, " " * 3000, "\x00 x", *["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)], *[r["text"] for r in docs.limit(60).collect()]]
    ids = lib.encode(texts)
    assert enc.encode(pa.array(texts)).to_pylist() == ids
    assert [enc.decode(x) for x in ids] == [lib.decode(x) for x in ids]
    broken = [rng.integers(0, 300, rng.integers(0, 7)).tolist() for _ in range(500)]
    assert [enc.decode(x) for x in broken] == [lib.decode(x) for x in broken]
    for df in (docs, odd, none):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            x = lib.encode(r["text"] or "")
            want[r["doc_id"], len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in piece_bpe.token_digests(df, tokenizer(PIECE_MODEL)).collect()) == want
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(odd, tokenizer(PIECE_MODEL)), tokenizer(PIECE_MODEL))
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


# --------------------------------------------------------------------------- 10 quality classifier


def test_em_finds_the_accurate_labeller():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.8
    vote = lambda p: np.where(rng.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    votes = np.stack([vote(0.97), vote(0.9), vote(0.6)], axis=1)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    m = quality_classifier.expectation_maximisation(pats, n.astype(float))
    right = [m.chance[j][1][2] for j in range(3)]
    assert right[0] > right[1] > right[2]
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95


def test_classifier_held_out(spark, docs, odd, none):
    labels = table(spark, "/root/testdata/sf0.01", "labels").toPandas().set_index("doc_id")["quality"]
    out = quality_classifier.classify(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    out = out[out["doc_id"].isin(labels.index)]
    y = out["doc_id"].map(labels)
    assert out["kept"][y == 1].mean() >= 0.95 and out["kept"][y == 0].mean() <= 0.2
    o = quality_classifier.classify(odd).collect()
    assert len(o) == 8 and all(r["score"] == 0 and not r["kept"] for r in o if not r["n_words"])
    assert quality_classifier.classify(none).count() == 0


# --------------------------------------------------------------------------- shared


def test_prefix_sums(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", None, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {(r["g"], r["i"]): (r["before"], r["row"]) for r in common.prefix_sums(df, ["i"], "v", ["g"]).collect()}
    for g in ("a", None, "b"):
        assert [got[g, i] for i in range(40)] == [(sum((j * 7) % 5 for j in range(i)), i) for i in range(40)]


def test_windows_of_words():
    texts = pa.array(["a b c d e f g h a b c d e f g h", "a b c d e f g h", "", None, "x " * 20])
    assert textstats.counts(texts)["n_repeat_words"].tolist() == [16, 0, 0, 0, 20]


def test_every_operator_has_a_query(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_workers_give_memory_back_and_encode_small_pieces(monkeypatch):
    import pyarrow as pa

    from loomgraph.llm import common, piece_bpe

    gave = []
    monkeypatch.setattr(common, "give_back", lambda: gave.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 20_000] * 100)], ["text"])
    parts = list(common.chunks(batch, 0, piece_bpe.CHUNK))
    assert gave and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) * 100_000 <= 3 << 20
