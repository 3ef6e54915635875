"""Property checks: C1 keeps its invariants on random
paragraph layouts, X2 equals Python's urljoin on random references, and D1's
kept set is independent and maximal on the LSH buckets."""

from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docforge.operators.dedup import bucket_members, greedy_dedup
from docforge.functions.url import with_url_join
from docforge.params import HarvestParams
from tests.conftest import SF_SMALL
from tests.test_chunk import check_invariants, fold

paragraph = st.text(alphabet="ab \n", min_size=0, max_size=700)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(paragraph, min_size=0, max_size=12), min_size=1, max_size=40),
       st.integers(min_value=50, max_value=2500), st.integers(min_value=0, max_value=400))
def test_chunk_fold_invariants(spark, docs, mx, mn):
    texts = ["\n\n".join(d) for d in docs]
    p = HarvestParams(chunk_max=mx, chunk_min=mn)
    for i, chunks in fold(spark, texts, p).items():
        check_invariants(texts[i], chunks, p)


segment = st.sampled_from(["a", "b", "..", ".", "", "c.html", "d;p", "x y"])
reference = st.builds(
    lambda pre, segs, q, f: pre + "/".join(segs) + q + f,
    st.sampled_from(["", "/", "//h2/", "./", "../", "https://o/", "http:", "mailto:"]),
    st.lists(segment, max_size=5),
    st.sampled_from(["", "?", "?k=v"]),
    st.sampled_from(["", "#", "#frag"]))
base = st.sampled_from(["https://h/a/b", "https://h/a/b/", "https://h", "http://h/x?y=1#z",
                        "https://u@h:81/p/q/r.html"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(base, reference), min_size=1, max_size=60))
def test_url_join_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, l string")
    got = [(r.b, r.l, r.j) for r in with_url_join(df, "b", "l", "j").collect()]
    for b, l_, j in got:
        assert j == urljoin(b, l_), (b, l_)


def test_greedy_kept_set_is_independent_and_maximal(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    p = HarvestParams()
    keep = {r.doc_id: r.keep for r in greedy_dedup(docs, "doc_id", "doc_id", "text", p).collect()}
    m = bucket_members(docs, "doc_id", "doc_id", "text", p).collect()
    buckets = {}
    for r in m:
        buckets.setdefault((r._band, r._bkey), []).append(r._id)
    neighbours = {d: set() for d in keep}
    for ids in buckets.values():
        for a in ids:
            neighbours[a].update(x for x in ids if x != a)
    for d, k in keep.items():
        earlier_kept = [x for x in neighbours[d] if x < d and keep[x]]
        if k:
            assert not [x for x in neighbours[d] if keep[x]], d      # independent
        else:
            assert earlier_kept, d                                   # maximal / first-wins
