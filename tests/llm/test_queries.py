"""The thin queries over the smallest driver tables, against plain versions of their contracts."""

import collections
import hashlib
import os
import re
import zlib

import pytest

from tessera.llm import op3_pii_crf, op7_telephony, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}


def spans(rows):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in rows)


def test_chat(spark):
    turns = collections.defaultdict(list)
    for r in queries.table(spark, SF, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    text = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", text), (1, "assistant", text)]
    got = queries.op1_chat_windows(spark, SF).collect()
    assert len(got) == len(turns)
    for g in got:
        want = sorted(turns[g["conv_id"]])
        learned = "".join(t for _, r, t in want if r == "assistant")
        assert (g["n_turns"], g["turns_sha256"]) == (len(want), sha("".join(f"{r}\n{t}\n" for _, r, t in want)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), sha(learned)) and g["formatted_chars"] > sum(len(t) for _, _, t in want)


def test_pii(spark, docs):
    from test_brute import plain_pii

    for g in queries.op3_pii_spans(spark, SF).collect():
        want = plain_pii(docs[g["doc_id"]]["text"] or "")
        assert [g[f"n_{k}"] for k in op3_pii_crf.KINDS] == [sum(s[0] == k for s in want) for k in op3_pii_crf.KINDS]
        assert g["base_sha256"] == sha(spans(want)) and set(spans(want).split(",")) - {""} <= set(g["spans"].split(","))


def test_secrets(spark, docs):
    rules = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    for g in queries.op4_secret_spans(spark, SF).collect():
        text = docs[g["doc_id"]]["text"] or ""
        want = sorted(((k, m.start(), m.end()) for k, r, i, n in rules for m in re.finditer(r, text) if len(m[i]) >= n), key=lambda s: (s[1], [r[0] for r in rules].index(s[0])))
        assert [g[f"n_{r[0]}"] for r in rules] == [sum(s[0] == r[0] for s in want) for r in rules]
        assert g["base_sha256"] == sha(spans(want))


def test_language(spark, docs):
    got = queries.op5_language(spark, SF).collect()
    held = [g for g in got if g["held_out"]]
    assert len(got) == len(docs) and all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)
    assert sum(g["lang_pred"] == docs[g["doc_id"]]["lang"] for g in held) / len(held) > 0.85


def test_audio(spark, docs):
    for g in queries.op7_telephony_columns(spark, SF).collect():
        raw = (docs[g["doc_id"]]["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = op7_telephony.wav(op7_telephony.FORMATS[zlib.crc32(payload) % 3], payload)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), sha(media)) and g["feature"].split(":")[0] in op7_telephony.FORMATS


def test_mix(spark, docs):
    got = queries.op8_source_mix(spark, SF).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for d, r in docs.items()}
    by = collections.Counter()
    for d, r in docs.items():
        by[r["source"]] += size[d]
    from test_brute import plain_targets

    target = plain_targets(by)
    want = {s: (by[s], target[s]) for s in by}
    for g in got:
        n, t = want[docs[g["doc_id"]]["source"]]
        assert (g["size"], g["source_size"]) == (size[g["doc_id"]], n) and g["target"] == pytest.approx(t) and g["taken"] in [k * g["size"] for k in range(4)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    res = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert names == df.columns and sorted(map(tuple, df.collect())) == sorted(res.fetchall())


def test_rollup(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") if line.strip())}
    bpe = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    labels = collections.defaultdict(lambda: (0, 1))
    for r in queries.table(spark, SF, "labels").collect():
        t, q = labels.get(r["doc_id"], (0, 1))
        labels[r["doc_id"]] = (max(t, r["toxic"]), min(q, r["quality"]))
    want = collections.Counter()
    for d, r in docs.items():
        toxic, quality = labels[d]
        if toxic == 1:
            continue
        text = "\n".join(dict.fromkeys(r["text"].split("\n"))) if quality == 0 else r["text"]
        want[(r["source"], r["lang"], "words-1")] += len(text.encode().split())
        want[(r["source"], r["lang"], "byte-bpe-50k")] += len(bpe.encode_ordinary(text))
    got = {(g["source"], g["lang"], g["tokenizer"]): g["n_tokens"] for g in queries.op10_token_rollup(spark, SF).collect() if g["n_docs"]}
    assert got == dict(want)
