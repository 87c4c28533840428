"""The corpus pipeline, stage by stage, against plain versions of what each stage keeps."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import op5_langid
from tessera.llm.queries import table
from tessera.llm.store import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        made = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (a, b) for name, a, b in out}


def test_stages_are_the_named_ones(tables):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for name, (a, b) in tables.items():
        assert b.columns[: len(a.columns)] == a.columns and (name == "mixing" or b.columns == a.columns)


def test_language_drops_only_rejects(spark, tables):
    a, b = tables["language"]
    found = op5_langid.identify(a, op5_langid.fit(a.where(F.coalesce(op5_langid.fold(F.col("doc_id")) != 0, F.lit(True)))))
    want = {r["doc_id"]: r["langid"]["lang_pred"] for r in found.collect() if not r["langid"]["rejected"]}
    assert {r["doc_id"]: r["lang"] for r in b.collect()} == want and len(want) > 0.9 * a.count()


def test_one_of_each_group_stays(tables):
    from test_brute import plain_components

    a, b = tables["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(d for d, _, c in plain_components(rows, 5) if c == d)


def test_contaminated_documents_go(spark, tables):
    from test_brute import plain_hits

    a, b = tables["decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = []
    for r in a.collect():
        n, hit, _ = plain_hits_fast(r["text"], items, plain_hits)
        # All items of these tables are longer than a window, so any hit is a window's.
        assert min(len(t.split()) for _, t in items) >= 13
        if not hit:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(want)


def plain_hits_fast(text, items, slow):
    """The slow version over the items that share their first word with the text only."""
    low = (text or "").lower()
    near = [(n, t) for n, t in items if any(w.lower() in low for w in t.split()[:1])]
    return slow(text, near) if len(low) < 8000 else slow(text, [(n, t) for n, t in near if t[:30].lower() in low or t[-30:].lower() in low or any(t[k : k + 60].lower() in low for k in range(0, max(1, len(t) - 60), 10))])


def test_personal_data_is_masked(tables):
    from test_brute import plain_pii

    a, b = tables["personal_data"]
    before = {r["doc_id"]: r["text"] for r in a.collect()}
    rows = b.collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and not plain_pii(r["text"])
        if not plain_pii(before[r["doc_id"]]):
            assert "<" in r["text"] or r["text"] == before[r["doc_id"]]


def test_the_mix_meets_its_targets(tables):
    from test_brute import plain_targets

    a, b = tables["mixing"]
    words = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in a.collect()}
    got = {r["doc_id"]: r["copies"] for r in b.collect()}
    assert all(1 <= c <= 3 for c in got.values()) and set(got) <= set(words)
    sizes: dict = {}
    for s, n in words.values():
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    taken = {s: sum(words[d][1] * c for d, c in got.items() if words[d][0] == s) for s in sizes}
    assert abs(sum(taken.values()) - sum(want.values())) < 0.05 * sum(want.values())
    largest = {s: max(n for t, n in words.values() if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 0.5 * largest[s] for s in sizes)


def test_run_gives_the_last_stage(spark, tables):
    made = P.run(spark, SF)
    assert sorted((r["doc_id"], r["copies"]) for r in made.collect()) == sorted((r["doc_id"], r["copies"]) for r in tables["mixing"][1].collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies string, _hash string, _h string, PII string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "c", "h", "g", "p") for i, t, lang, src in rows], COLUMNS)


def test_stages_on_odd_tables(spark):
    text = table(spark, SF, "documents").where("lang = 'de' and length(text) > 400").orderBy("doc_id").first()["text"][:400]
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows = [(1, text, "de", "a"), (1, text, "de", "a"), (2, text, None, None), (None, text, "de", "a"), (3, None, "de", "b"), (4, "", None, "b"), (5, "12 34", "de", None), (6, text.replace(" ", "\n") * 400 + " x@y.de", "de", "c"), (7, text + " call (555) 123-4567 now", "de", "c"), (None, None, None, None), (8, text * 60 + " " + item, "de", "c")]
    docs = odd(spark, rows)
    got = {name: stage(spark, docs, SF) for name, stage in P.STAGES}
    for name, stage in P.STAGES:
        none = stage(spark, docs.limit(0), SF)
        if name == "mixing":
            assert none.count() == 0 and got[name].columns == [c if c != "copies" else "copies_input" for c in docs.columns] + ["copies"]
        else:
            assert none.count() == 0 and none.columns == docs.columns == got[name].columns
        assert all(r["_hash"] == "h" and r["_h"] == "g" and r["PII"] == "p" for r in got[name].collect())
    ids = lambda name: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got[name].collect())
    assert ids("language") == [-1, 1, 1, 2, 6, 7, 8] and {r["lang"] for r in got["language"].collect()} == {"de"}
    # 1, 2 and the row without an id have one text; 6 repeats it, but has shingles of its own seams only.
    assert set(ids("near_duplicates")) >= {-1, 1, 3, 4, 5} and ids("near_duplicates").count(1) == 1 and 2 not in ids("near_duplicates") and ids("near_duplicates").count(-1) == 1
    assert ids("decontamination") == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7]
    masked = {r["doc_id"]: r for r in got["personal_data"].collect()}
    assert masked[6]["text"].endswith(" <email>") and "<phone>" in masked[7]["text"] and masked[3]["text"] is None and masked[3]["n_chars"] is None and len(got["personal_data"].collect()) == len(rows)
    mixed = got["mixing"].collect()
    assert all(r["copies"] >= 1 and r["copies_input"] == "c" for r in mixed) and len({(r["doc_id"], r["text"], r["source"]) for r in mixed}) == len(mixed)


def test_a_passage_in_a_long_document_goes(spark):
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    filler = " ".join(f"w{k}" for k in range(20_000))
    window = " ".join(item.split()[:13])
    docs = odd(spark, [(1, f"{filler} {window} {filler}", "de", "a"), (2, filler, "de", "a"), (3, filler + " " + " ".join(item.split()[:12]), "de", "a")])
    assert sorted(r["doc_id"] for r in P.decontamination(spark, docs, SF).collect()) == [2, 3]
