"""MinHash / LSH / greedy dedup (FIXTURES section 2)."""

from pyspark.sql import functions as F

from docforge.functions.minhash import jaccard_estimate, signature
from docforge.operators.dedup import greedy_dedup, greedy_rounds

A = "This is a security document about AWS IAM."
B = "This is a completely different document about Azure security."


def _sig_df(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return df.select("id", signature(F.col("text")).alias("sig"))


def test_identical_and_different(spark):
    s = {r.id: r.sig for r in _sig_df(spark, [A, A, B]).collect()}
    pair = spark.createDataFrame([(s[0], s[1], s[2])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = pair.select(jaccard_estimate(F.col("a"), F.col("b")).alias("same"),
                    jaccard_estimate(F.col("a"), F.col("c")).alias("diff")).first()
    assert r.same == 1.0
    assert r.diff < 0.85
    assert len(s[0]) == 128


def _dedup(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r.keep for r in greedy_dedup(df, "id", "id", "text").collect()}


def test_exact_repeat_dropped(spark):
    assert _dedup(spark, [A, A]) == {0: True, 1: False}


def test_unrelated_kept(spark):
    got = _dedup(spark, ["AWS IAM security best practices",
                         "Azure Active Directory configuration guide"])
    assert got == {0: True, 1: True}


def test_near_case_is_boolean(spark):
    got = _dedup(spark, ["AWS Identity and Access Management (IAM) is a web service.",
                         "AWS Identity and Access Management IAM is a web service."])
    assert got[0] is True and isinstance(got[1], bool)


def _rounds(spark, edges, n):
    # one bucket per edge: greedy first-wins on the edge graph
    rows = [(i, i, 0, f"solo{i}") for i in range(1, n + 1)]
    for k, (a, b) in enumerate(edges):
        rows += [(a, a, 1, f"e{k}"), (b, b, 1, f"e{k}")]
    m = spark.createDataFrame(rows, "_id long, _ord long, _band int, _bkey string")
    return {r._id for r in greedy_rounds(m).collect() if r._keep}


def test_greedy_is_not_connected_components(spark):
    assert _rounds(spark, [(1, 2), (2, 3)], 3) == {1, 3}
    assert _rounds(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], 5) == {1, 3, 5}
    assert _rounds(spark, [(1, 2), (1, 3), (1, 4)], 4) == {1}
    assert _rounds(spark, [(1, 4), (2, 4), (3, 4)], 4) == {1, 2, 3}


def test_dedup_invariant_under_repartition(spark):
    texts = [A, B, A + " extra", B, "unrelated words entirely here", A]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    one = {r.id: r.keep for r in greedy_dedup(df.coalesce(1), "id", "id", "text").collect()}
    many = {r.id: r.keep for r in greedy_dedup(df.repartition(5), "id", "id", "text").collect()}
    assert one == many
    assert one[0] and not one[5] and not one[3]


def _sequential_greedy(members):
    """Brute-force reference: visit ids in order, keep unless a kept id
    shares a bucket."""
    by_id = {}
    for r in members:
        by_id.setdefault(r._id, set()).add((r._band, r._bkey))
    kept_buckets, keep = set(), {}
    for i in sorted(by_id):
        if by_id[i] & kept_buckets:
            keep[i] = False
        else:
            keep[i] = True
            kept_buckets |= by_id[i]
    return keep


def test_hot_bucket_matches_sequential(spark):
    """A third of the rows are near copies of one text (one giant bucket per
    band); the result must equal the sequential rule, with nothing capped."""
    from docforge.operators.dedup import bucket_members
    base = " ".join(f"w{k}" for k in range(120))
    texts = []
    for i in range(1200):
        if i % 3 == 0:
            texts.append(base + f" v{i}")          # near copies: share buckets
        else:
            texts.append(" ".join(f"u{i}x{k}" for k in range(30)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.keep for r in greedy_dedup(df, "id", "id", "text").collect()}
    members = bucket_members(df, "id", "id", "text").collect()
    assert got == _sequential_greedy(members)
    hot = [i for i in range(0, 1200, 3)]
    assert got[0] and sum(got[i] for i in hot) < len(hot) // 2


def test_null_and_empty_texts_are_one_document(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "x y")], "id long, text string")
    got = {r.id: r.keep for r in greedy_dedup(df, "id", "id", "text").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_long_path_is_decided_to_its_end(spark):
    """No bound on rounds: along a path every second document is kept."""
    n = 14
    assert _rounds(spark, [(i, i + 1) for i in range(1, n)], n) == set(range(1, n + 1, 2))


def test_a_path_of_a_thousand_takes_few_rounds(spark, caplog):
    """Each document of a path has one earlier neighbour: pointer doubling, not n / 2 rounds."""
    n = 1000
    with caplog.at_level("INFO", logger="docforge.operators.dedup"):
        got = _rounds(spark, [(i, i + 1) for i in range(1, n)], n)
    assert got == set(range(1, n + 1, 2))
    assert [r.args[0] for r in caplog.records if "rounds" in r.msg][-1] <= 15


def test_chains_among_other_edges_match_sequential(spark):
    """Trees, cycles and hubs: links to one earlier neighbour never decide wrongly."""
    import random
    rng = random.Random(11)
    for n, m in ((60, 55), (40, 90)):
        edges = sorted({tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(m)})
        edges += [(n + k, n + k + 1) for k in range(1, 20)] + [(3, n + 1)]
        total = n + 20
        kept, near = set(), {}
        for a, b in edges:
            near.setdefault(b, set()).add(a)
        for d in range(1, total + 1):
            if not near.get(d, set()) & kept:
                kept.add(d)
        assert _rounds(spark, edges, total) == kept


def test_bands_follow_the_threshold():
    from docforge.params import HarvestParams, lsh_bands_rows
    assert (HarvestParams().bands, HarvestParams().rows) == (8, 16)
    for t in (0.3, 0.6, 0.95):
        b, r = lsh_bands_rows(t)
        p = HarvestParams(threshold=t)
        assert (p.bands, p.rows) == (b, r) and b * r <= 128
        assert abs((1 / b) ** (1 / r) - t) < 0.12          # where the curve turns


def test_signatures_are_computed_once_for_the_buckets(spark):
    """What is exploded and joined is written: no signature is left in the plan of the members."""
    from docforge.operators.dedup import bucket_members
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    plan = bucket_members(df, "id", "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_signature_equals_the_rule_slot_by_slot(spark):
    """Any number of tokens (blocks of 128), blanks beyond ASCII, empty and null texts; tokens
    are taken in the worker, not by a fold in the plan."""
    import hashlib
    from pyspark.sql import functions as F
    from docforge.functions.minhash import EMPTY_SLOT, MERSENNE, perm_params, signature, token_set_digest
    texts = ["a", "a\xa0b\x85c a", " \n", "", None, " ".join(f"w{i}" for i in range(128)), " ".join(f"\xe9{i}" for i in range(300))]

    def by_rule(text):
        h = {int(hashlib.md5(t.encode()).hexdigest()[:8], 16) & MERSENNE for t in (text or "").split()}
        return [min((a * x + b) % MERSENNE for x in h) if h else EMPTY_SLOT for a, b in perm_params()]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", signature(F.col("t")).alias("s"), token_set_digest(F.col("t")).alias("d"))
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: (r.s, r.d) for r in df.collect()}
    assert got == {i: (by_rule(t), t if t is None else hashlib.md5(" ".join(sorted(set(t.split()))).encode()).hexdigest())
                   for i, t in enumerate(texts)}


def test_dedup_keys_are_digest_and_band_keys_of_one_pass(spark):
    """Equal to the two columns they stand for; one Python function, which takes the tokens once."""
    from pyspark.sql import functions as F
    from docforge.functions.minhash import band_keys, dedup_keys, signature, token_set_digest
    from docforge.operators.dedup import doc_signatures
    texts = ["a", "b a\xa0b", " \n", "", None, " ".join(f"w{i}" for i in range(700)), "a", " ".join(f"w{i % 9}" for i in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.coalesce("t", F.lit(""))
    for bands, rows in ((8, 16), (3, 50)):          # the last band of the second has 28 slots
        want = df.select("i", token_set_digest(t).alias("d"), band_keys(signature(t), bands, rows).alias("b")).collect()
        k = dedup_keys(t, 128, bands, rows)
        assert sorted(df.select("i", k["digest"].alias("d"), k["bkeys"].alias("b")).collect()) == sorted(want)
    null = df.select(dedup_keys(F.col("t"), 128, 8, 16).alias("k")).where("t IS NULL").first().k
    assert null is None or (null.digest, null.bkeys) == (None, None)
    plan = doc_signatures(df, "i", "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dedup_keys(") == 1 and "minhash_signature(" not in plan and "token_set_md5(" not in plan
