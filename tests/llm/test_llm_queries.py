"""The queries: those with SQL equal it, the others equal plain rules; the smallest tables."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

queries = pytest.importorskip("slatework.llm.queries")
#: Queries that the tests below and test_canonical compare with plain rules.
PLAIN = {"p3_found", "p3_unmatched", "p3_candidates", "p4_similar", "p7_found", "p7_splits", "p7_shares", "p8_ids", "p9_mix", "p9_shares", "p10_found", "p10_pieces"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, a[cols].astype(str).values.tolist())) == sorted(map(tuple, b[cols].astype(str).values.tolist()))


def test_every_query_is_compared():
    assert set(queries.QUERIES) == set(queries.SQL) | PLAIN


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def cities(spark, sf):
    """record_id -> city_id, exact or mapped."""
    names = {r.city_name: r.city_id for r in pd.read_parquet(f"{sf}/city_reference.parquet").itertuples()}
    b = pd.read_parquet(f"{sf}/building_metadata.parquet")
    out = {r.record_id: names[r.city] for r in b.itertuples() if r.city in names}
    found = run(spark, sf, "p3_found")
    return out | {r.row_id: r.ref_id for r in found.itertuples() if r.field == "city" and r.ref_id >= 0}


def test_unmatched_values_are_counted(spark, sf):
    found = run(spark, sf, "p3_found")
    want = Counter(found.field[found.ref_id == -1])
    assert {r.field: r.rows for r in run(spark, sf, "p3_unmatched").itertuples()} == dict(want)


def plain_splits(sf):
    b = pd.read_parquet(f"{sf}/building_metadata.parquet")
    return {r.record_id: s for r in b.itertuples() if (s := str(r.split).strip().lower()) in ("train", "val", "holdout")}


def test_cities_in_several_splits(spark, sf, cities):
    now, seen = plain_splits(sf), defaultdict(set)
    for record, city in cities.items():
        if record in now:
            seen[city].add(now[record])
    assert {r.city_id for r in run(spark, sf, "p7_found").itertuples()} == {c for c, s in seen.items() if len(s) > 1}


def test_splits_keep_cities_and_images_together(spark, sf, cities):
    from slatework.llm import lookalike

    got = run(spark, sf, "p7_splits")
    rows = list(pd.read_parquet(f"{sf}/building_metadata.parquet").record_id)
    assert sorted(got.record_id) == sorted(rows)
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    images = lookalike.one_form(spark.read.parquet(f"{sf}/building_metadata.parquet"), "filename", "image", keep=("record_id",)).where("form <> ''").collect()
    for record, key in [*cities.items(), *((r.record_id, r.form) for r in images)]:
        parent[top(("r", record))] = top(("k", key))
    groups = defaultdict(set)
    for r in got.itertuples():
        groups[top(("r", r.record_id))].add(r.component)
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert got.groupby("component").split.nunique().max() == 1
    shares = run(spark, sf, "p7_shares")
    assert dict(zip(shares.split, shares.records, strict=True)) == dict(Counter(got.split))
    assert abs(shares.reached_share - shares.target_share).max() < 0.02


def alone(edges):
    """A component for each node."""
    return edges.selectExpr("a as node").union(edges.selectExpr("b")).distinct().selectExpr("node", "node as component")


def test_cities_come_from_the_components(spark, monkeypatch):
    """Where nothing is connected, cities aren't brought together, and those torn apart aren't reported."""
    from slatework.llm import splits

    sf = "/root/testdata/sf0.01"
    whole = set(run(spark, sf, "p7_found").city_id)
    monkeypatch.setattr(splits, "components", alone)
    assert set(run(spark, sf, "p7_found").city_id) < whole


def test_names_come_from_the_join(spark, monkeypatch):
    """Without the join on rare words no pair is found by name."""
    from slatework.llm import overlap

    sf = "/root/testdata/sf0.01"
    whole = {tuple(r) for r in run(spark, sf, "p4_found").values.tolist()}
    nothing = "text_e string, text_t string, similarity double"
    monkeypatch.setattr(overlap, "similar_sides", lambda texts, *_, **__: spark.createDataFrame([], nothing))
    assert {tuple(r) for r in run(spark, sf, "p4_found").values.tolist()} < whole


@pytest.fixture(scope="module")
def tokens(sf):
    """Ids of every document by another tokenizer of the same vocabulary."""
    tiktoken = pytest.importorskip("tiktoken")
    from slatework.llm import bpe

    enc = tiktoken.Encoding("plain", pat_str=bpe.WORDS, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    return docs, {r.doc_id: enc.encode_ordinary(r.text) if isinstance(r.text, str) else [] for r in docs.itertuples()}


def test_ids_of_every_document(spark, sf, tokens):
    got = {r.doc_id: list(r.ids) for r in run(spark, sf, "p8_ids").itertuples()}
    assert got == tokens[1]


def test_mix_meets_its_shares(spark, sf, tokens):
    docs, ids = tokens
    targets = pd.read_parquet(f"{sf}/mix_targets.parquet").set_index("source")
    size = Counter()
    for r in docs.itertuples():
        size[r.source] += len(ids[r.doc_id])
    mix, report = run(spark, sf, "p9_mix"), run(spark, sf, "p9_shares").set_index("source")
    assert mix.position.is_monotonic_increasing
    assert not mix.duplicated(["doc_id", "repeat"]).any()
    assert all(t == len(ids[i]) for i, t in zip(mix.doc_id, mix.tokens, strict=True))
    used = mix.groupby("source").tokens.sum()
    assert used.to_dict() == report.used_tokens[report.used_tokens > 0].to_dict()
    assert all(r <= targets.max_repeats[s] for s, r in mix.groupby("source").repeat.max().items())
    largest = max(map(len, ids.values()))
    share = targets.target_share / targets.target_share.sum()
    assert all(abs(used[s] - share[s] * used.sum()) <= 2 * largest for s in used.index)
    # The scarcest source is used up to its repeats.
    total = min(targets.max_repeats[s] * size[s] / share[s] for s in targets.index if size[s])
    assert abs(used.sum() - total) <= 8 * largest
    assert report.left_out_tokens.to_dict() == {s: size[s] - sum(len(ids[i]) for i in set(mix.doc_id[mix.source == s])) for s in report.index}


def test_pieces_of_long_documents(spark, sf, tokens):
    docs, ids = tokens
    rule = pd.read_parquet(f"{sf}/piece_rules.parquet").iloc[0]
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert set(run(spark, sf, "p10_found").doc_id) == {i for i, t in ids.items() if len(t) > rule.max_tokens}
    pieces = run(spark, sf, "p10_pieces")
    assert set(pieces.doc_id) == {i for i, t in text.items() if t}
    assert (pieces.tokens <= rule.max_tokens).all()
    for i, p in pieces.sort_values("piece_no").groupby("doc_id"):
        assert p.start_char.iloc[0] == 0
        assert p.end_char.iloc[-1] == len(text[i])
        assert all(text[i][s:e] == t for s, e, t in zip(p.start_char, p.end_char, p.text, strict=True))
        assert all(rule.overlap_tokens <= n <= rule.overlap_tokens + 3 for n in p.shared_tokens.iloc[1:] if n)


def test_similar_names(spark):
    """All pairs of names of one image are among the similar ones, and names that aren't too."""
    from slatework.llm import lookalike

    sf = "/root/testdata/sf0.01"
    got = run(spark, sf, "p4_similar")
    assert got.similarity.between(0.5, 1.0).all()
    assert not got.duplicated(["name_e", "name_t"]).any()
    now = plain_splits(sf)
    sides = defaultdict(lambda: (set(), set()))
    for r in lookalike.image_names(spark.read.parquet(f"{sf}/building_metadata.parquet").withColumnRenamed("filename", "f"), "f", keep=("record_id",)).collect():
        if r.record_id in now:
            sides[r.image][now[r.record_id] == "train"].add(r.name)
    want = {(e, t) for a, b in sides.values() for e in a for t in b}
    assert len(want) > 20
    assert {(r.name_e, r.name_t) for r in got[got.same_image].itertuples()} == want
