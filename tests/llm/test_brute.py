"""Each operator against a plain version of its rules, on small tables with nulls, blanks, ties and long texts."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_chat, op2_suffix_tree, op3_pii_crf, op4_secrets, op5_langid, op6_circulant_minhash, op7_telephony, op8_mixing, op9_decontamination, op10_rollups
from tessera.llm import text as X

DOC = "doc_id long, text string, lang string, source string, extra string"


def words(text):
    return (text or "").encode().lower().split()


def grown(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rows and rng.random() < 0.4 and rows[-1]:
            ws = list(rows[rng.randrange(len(rows))])
            for _ in range(rng.randint(0, max(1, len(ws) // 12))):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
        rows.append(ws)
    texts = [rng.choice([" ", "\n", "\t "]).join(w) for w in rows]
    return [*texts, None, "", "  \n", "one", "One", "a b c", "long " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = grown(3)
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4], "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", "en", "s1", "x"), (2, texts[2], "en", "s1", "x")], DOC).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_words_and_grams_match_plain_python():
    import pyarrow as pa

    texts = grown(11)
    seen = {}
    for limit in (40, 1 << 20):
        for lo, hi, data, off in X.slices(pa.array(texts, pa.string()), limit):
            w = X.words(data, off)
            g, ends = X.grams(w, 4)
            sets, bounds = X.unique_per_doc(g, ends)
            for i in range(lo, hi):
                want = words(texts[i])
                assert [bytes(w.data[w.starts[k] : w.ends[k]]) for k in range(w.first[i - lo], w.first[i - lo + 1])] == want
                runs = [tuple(want[k : k + 4]) for k in range(len(want) - 3)] if len(want) >= 4 else [tuple(want)] * bool(want)
                assert [seen.setdefault(r, h) for r, h in zip(runs, g[ends[i - lo] : ends[i - lo + 1]], strict=True)] == list(g[ends[i - lo] : ends[i - lo + 1]])
                assert bounds[i - lo + 1] - bounds[i - lo] == len(set(runs))
    assert len(set(seen.values())) == len(seen)


def test_chat_round_trip_and_masks(spark):
    rng = random.Random(2)
    parts = ["</s>", "[INST]", "\\", "\\l", "<", "[", "<|im_end|>\n", "<|im_start|>", "é😀", "\n", "word ", "<<SYS>>"]
    rows = [(c, rng.choice([None, t, t * 40, t]), rng.choice(["user", "assistant", "system", None, "we\nird\\w"]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 90)))]), "x") for c in [*range(20), None] for t in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    want = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    for kw in ({}, {"budget": 40, "history": 12}, {"block": 16}):
        made = op1_chat.windows(df, **kw).cache()
        got = op1_chat.read_back(made).collect()
        assert len(got) == len(want)
        for g in got:
            turns = sorted(want[g["conv_id"]])
            assert [(t["role"], t["text"]) for t in g["turns"]] == [x[2:] for x in turns]
            assert g["learned"] == "".join(x[3] for x in turns if x[2] == "assistant")
        for w in made.select("text", "loss").collect():
            body = re.sub(r"<\|im_start\|>[^\n]*\n|<\|im_end\|>\n", "", w["text"])
            assert not re.search(r"</?s>|\[/?INST\]|<\|", body)
            assert all(w["text"][s["start"] + s["length"] :].startswith("<|im_end|>") for s in w["loss"])
    assert op1_chat.read_back(op1_chat.windows(df.limit(0))).count() == 0


def test_chat_history_crosses_blocks_and_turn_numbers(spark):
    far = [(1, t * 5000, "user" if t % 2 == 0 else "assistant", f"w{t} b c") for t in range(10)]
    schema = "conv_id long, turn long, role string, text string"
    assert op1_chat.windows(spark.createDataFrame(far, schema)).count() == 1
    rows = [(1, 0, "system", "be nice")] + [(1, t // 3, "user" if t % 2 else "assistant", " ".join(f"t{t}x{k}" for k in range(t % 9 + 1))) for t in range(3, 700)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, schema).repartition(5)
    for kw in ({"block": 200}, {"block": 200, "history_turns": 0}, {"block": 1000, "history": 40, "history_turns": 5}):
        made = op1_chat.windows(df, **kw).cache()
        got = {r["conv_id"]: r for r in op1_chat.read_back(made).collect()}[1]
        want = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1:])
        assert [(t["role"], t["text"]) for t in got["turns"]] == [r[2:] for r in want] and got["learned"] == "".join(r[3] for r in want if r[2] == "assistant")
        one = made.where("conv_id = 1").orderBy("block", "window").collect()
        assert one[-1]["block"] > 2 and all(w["text"].startswith("<|im_start|>system\nbe nice") for w in one)
        # Every window but the first, also one that begins a block, repeats the turns before it that fit.
        assert {w["context"] > 1 for w in one[1:]} == {kw.get("history_turns", 2) > 0}


def test_chat_budget_and_history(spark):
    rows = [(1, 0, "system", "rules here")] + [(1, t, "user" if t % 2 else "assistant", "one two three four five six") for t in range(1, 30)]
    made = op1_chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=25).orderBy("window").collect()
    assert len(made) > 3
    assert all(w["text"].startswith("<|im_start|>system\n") for w in made)
    assert all(w["context"] in (1, 2, 3) for w in made[1:])
    cost = [sum(len(re.findall(r"\w+|[^\w\s]", t)) + 4 for t in re.findall(r"<\|im_start\|>[^\n]*\n(.*?)<\|im_end\|>", w["text"], re.S)) for w in made]
    assert max(cost) <= 60


def test_suffix_tree_base_and_probabilities(spark, docs, empty):
    held = F.coalesce(op5_langid.fold(F.col("doc_id")) == 1, F.lit(False))
    fitted = op2_suffix_tree.fit(docs.where(~held))
    rows = docs.collect()
    train = [r for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    c = collections.Counter(w for r in train for w in words(r["text"]))
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert (fitted.tokens, fitted.types) == (n, v)
    got = collections.defaultdict(list)
    for r in op2_suffix_tree.score(docs, fitted).collect():
        got[r["id"]].append(r)
    for r in rows:
        ws = words(r["text"])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        g = got[r["doc_id"]].pop()
        assert (g["n_tokens"], g["n_known"]) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1)
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and g["score"] <= 0
    # Next-symbol probabilities of every state sum to one over the 256 bytes and the unseen symbol.
    m = fitted.model
    for k in range(len(m.contexts)):
        for ctx in m.contexts[k][:5]:
            total = (10 ** m.score((ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64))).sum() if k == len(m.contexts) - 1 else 0
            assert total <= 1 + 1e-9
            assert k < len(m.contexts) - 1 or total > 0.9
    none = op2_suffix_tree.fit(empty)
    assert (none.tokens, none.types) == (0, 0)
    assert op2_suffix_tree.score(docs, none).count() == len(rows) and op2_suffix_tree.score(empty, fitted).count() == 0


def plain_tree(texts):
    """The tree from plain dictionaries: (probabilities, retained contexts) by context, with no table cut."""
    depth, alphabet = op2_suffix_tree.DEPTH, 257.0
    n = collections.defaultdict(collections.Counter)
    spelled = lambda t: (b"\n" * depth) + b" ".join(words(t)) + b"\n"
    for t in texts:
        s = spelled(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                n[s[i - k : i]][s[i]] += 1
    total = sum(n[b""].values())
    p = {b"": {x: (n[b""][x] + 0.5) / (total + 0.5 * alphabet) for x in range(256)}}
    unseen = 0.5 / (total + 0.5 * alphabet)
    kept = {b""}
    for c in sorted(n, key=len):
        m = sum(n[c].values())
        if not c or m < op2_suffix_tree.MIN_COUNT:
            continue
        up, t = p[c[1:]], len(n[c])
        p[c] = {x: (n[c][x] + t * up[x]) / (m + t) for x in range(256)}
        if sum(k * math.log(k / m / up[x]) for x, k in n[c].items()) > 0.5 * t * math.log(m):
            kept |= {c[i:] for i in range(len(c))}

    def score(t):
        s = spelled(t)
        return sum(math.log10(p[next(s[i - k : i] for k in range(depth, -1, -1) if s[i - k : i] in kept)][s[i]]) for i in range(depth, len(s)))

    return score


def random_texts(size, docs=4000):
    """An Arrow batch of random words: nearly every word and run of six symbols is a new one."""
    symbols = np.random.default_rng(5).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8), size).tobytes().decode()
    each = size // docs
    texts = [symbols[i * each : (i + 1) * each] for i in range(docs)]
    return texts, pa.RecordBatch.from_arrays([pa.array(range(docs), pa.int64()), pa.array(range(docs), pa.int64()), pa.array(texts)], names=["rid", "id", "text"])


def traced(batches):
    """(batches, the most MB that numpy and Python held meanwhile; what comes out is memory of Arrow and does not count)."""
    tracemalloc.start()
    try:
        out = list(batches)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_suffix_tree_gathers_all_counts_in_bounded_memory():
    texts, batch = random_texts(16_000_000)
    out, peak = traced(op2_suffix_tree._gather(iter([batch.select(["text"])]), 48))
    assert peak < 130
    got = {-1: [], op2_suffix_tree.DEPTH: []}
    for x in out:
        assert x.nbytes < 6 << 20
        for b, k, keys, vals in zip(*(x.column(i).to_pylist() for i in range(4)), strict=True):
            got[k].append((np.frombuffer(keys, np.uint64), np.frombuffer(vals, np.int64)))
    w = X.words(*X.buffers(batch.column("text")))
    symbols, scored, _ = op2_suffix_tree.spelled(w, X.buffers(batch.column("text"))[1])
    for k, want in ((-1, w.hashes), (op2_suffix_tree.DEPTH, op2_suffix_tree.codes(symbols, scored))):
        keys, counts = op2_suffix_tree.counted(np.concatenate([x for x, _ in got[k]]), np.concatenate([y for _, y in got[k]]))
        plain, plain_counts = np.unique(want, return_counts=True)
        assert (keys == plain).all() and (counts == plain_counts).all()


def test_suffix_tree_measures_in_bounded_memory():
    texts, batch = random_texts(16_000_000)
    none = np.zeros(0, np.uint64), np.zeros(0)
    out, peak = traced(op2_suffix_tree._measure(iter([batch]), (*none, *none), 48, 0.0, 1))
    assert peak < 130
    found = {op2_suffix_tree._WORDS: 0, op2_suffix_tree._RUNS: 0}
    for x in out:
        for k, keys in zip(x.column("kind").to_pylist(), x.column("keys").to_pylist(), strict=True):
            if k:
                found[k] += len(keys) // 8
    assert found == {op2_suffix_tree._WORDS: sum(len(t.split()) for t in texts), op2_suffix_tree._RUNS: sum(max(1, len(" ".join(t.split())) + 1) for t in texts)}


def test_suffix_tree_hands_freed_memory_back():
    last = []

    def work():
        held = [np.full(100_000, 1.0) for _ in range(200)]
        last.append(held[-1])  # it keeps the allocator from giving the others back by itself
        yield from (pa.RecordBatch.from_arrays([pa.array([i])], names=["i"]) for i in range(3))

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024

    np.zeros(4_000_000).sum()  # from now on glibc takes arrays of that size from its heap
    before = anonymous()
    assert [b.column(0).to_pylist() for b in op2_suffix_tree._freed(work())] == [[0], [1], [2]]
    assert anonymous() < before + 20


def test_suffix_tree_tally_sums_by_key(monkeypatch):
    monkeypatch.setattr(op2_suffix_tree, "PENDING", 7)
    rng, want, tally = np.random.default_rng(2), collections.Counter(), op2_suffix_tree.Tally()
    for _ in range(50):
        x, c = op2_suffix_tree.counted(rng.integers(0, 60, rng.integers(0, 20)).astype(np.uint64) << np.uint64(58))
        want.update(dict(zip(x.tolist(), c.tolist(), strict=True)))
        tally.add(x, c)
    keys, vals = tally.taken()
    assert list(zip(keys.tolist(), vals.tolist(), strict=True)) == sorted(want.items())
    assert not len(tally.taken()[0])


@pytest.mark.parametrize("p_run", [5e-7, 1e-3, 1.0])
def test_suffix_tree_matches_plain_tree(spark, docs, p_run):
    fitted = op2_suffix_tree.fit(docs, p_run=p_run)
    want = plain_tree([r["text"] for r in docs.collect()])
    other = spark.createDataFrame([(1, "abcde never seen éñ bad"), (2, ""), (3, None)], "doc_id long, text string")
    for part in (docs, other):
        texts = collections.defaultdict(list)
        for r in part.collect():
            texts[r["doc_id"]].append(want(r["text"]))
        for r in op2_suffix_tree.score(part, fitted).collect():
            assert any(r["score"] == pytest.approx(x, rel=1e-9, abs=1e-8) for x in texts[r["id"]])


def test_suffix_tree_keeps_a_rare_context_in_a_larger_corpus(spark):
    """30 sights of a word are kept among 40 million other symbols, where a share of a millionth asks for 40."""
    rare = "zqxjv " * 30
    common = spark.range(400).select(F.concat(F.lit("w"), F.col("id")).alias("k"), F.expr("repeat(concat('abcde fghij klmno pqrst ', cast(id % 7 as string), ' '), 4000)").alias("text"))
    fitted = op2_suffix_tree.fit(common.select("text").unionByName(spark.createDataFrame([(rare,)], "text string")))
    got = op2_suffix_tree.score(spark.createDataFrame([(1, "zqxjv zqxjv zqxjv zqxjv")], "doc_id long, text string"), fitted).collect()[0]
    assert got["score"] > -20


def test_suffix_tree_beats_its_base_on_held_out_text(spark):
    rng = random.Random(1)
    langs = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(40)] for letters in ("abcde", "fghij", "klmno", "pqrst")]
    text = lambda i: " ".join(rng.choice(langs[i % 4]) for _ in range(80))
    df = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    fitted = op2_suffix_tree.fit(df.where("doc_id < 240"))
    s = op2_suffix_tree.score(df.where("doc_id >= 240"), fitted).agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert s[0] > 0.85 * s[1] > s[1]


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and op3_pii_crf.luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], op3_pii_crf.KINDS.index(s[0])))


def test_pii_rules_match_the_patterns():
    rng = random.Random(3)
    parts = ["1", "25", "300", ".", ".", "@", "a", "-", "+", " ", "(", ")", "x.y", "4111111111111111", "9", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(40))
        assert op3_pii_crf.rule_spans(t) == plain_pii(t)
    assert op3_pii_crf.rule_spans("1" * 50_000 + "." * 50_000 + "a" * 50_000 + "@" * 1000) == []


def test_field_decodes_best_paths_and_learns():
    f = op3_pii_crf.default_field()
    rows = op3_pii_crf.labelled_rows(200, 99)
    right = total = 0
    for w, t in rows:
        path = f.decode([op3_pii_crf.features(w)])[0]
        right += sum(op3_pii_crf.TAGS[a] == b for a, b in zip(path, t, strict=True))
        total += len(t)
    assert right / total > 0.95
    short = [op3_pii_crf.features(["call", "(017)", "555-7713"])]
    score, _ = f.tensor(short)
    k = len(op3_pii_crf.TAGS)
    every = [(score[0, 0, a] + f.move[-1, a] + score[0, 1, b] + f.move[a, b] + score[0, 2, c] + f.move[b, c], (a, b, c)) for a in range(k) for b in range(k) for c in range(k)]
    assert tuple(f.decode(short)[0]) == max(every)[1]


def test_pii_field_finds_odd_spellings_and_leaves_clean_text(spark):
    rng = random.Random(21)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8)))
    fill = lambda k: " ".join(word() for _ in range(k))
    planted = [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"00{digits(2)}-{digits(3)}-{digits(6)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{word()}é@{word()}.org"]
    clean = [lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 9)}.", lambda: f"{rng.randint(1900, 2030)}-05-12", lambda: f"${digits(2)}.{digits(2)}", lambda: digits(5), lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"@{word()}"]
    texts = [(True, f"{fill(6)} {rng.choice(planted)()} {fill(5)}") for _ in range(300)] + [(False, f"{fill(6)} {rng.choice(clean)()} {fill(5)}") for _ in range(600)]
    got = op3_pii_crf.find_batch([t for _, t in texts], op3_pii_crf.default_field())
    added = [any(not s[3] for s in spans) for spans in got]
    caught = sum(a for a, (bad, _) in zip(added, texts, strict=True) if bad)
    wrong = sum(a for a, (bad, _) in zip(added, texts, strict=True) if not bad)
    assert caught >= 0.8 * 300 and wrong <= 0.01 * 600
    rules = op3_pii_crf.find_batch(["mail ab.cd@mail3.org now", "host 10.20.30.40 up"], op3_pii_crf.default_field())
    assert [[(s[0], s[3], s[4]) for s in r] for r in rules] == [[("email", True, True)], [("ip", True, True)]]


def test_pii_adds_and_masks(spark, empty):
    rows = [(1, "call (017) 555-7713 or a.b@c.de now"), (2, None), (3, ""), (4, "version 3.2.1 of 2024-05-12"), (5, "x " * 40_000 + "10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in op3_pii_crf.mask_personal(op3_pii_crf.find_personal(df)).collect()}
    assert got[1]["text"] == "call <phone> or <email> now" and [s["rule"] for s in got[1]["pii"]] == [False, True]
    assert got[2]["text"] is None and got[2]["pii"] == [] and got[4]["pii"] == [] and got[5]["text"].endswith("<ip>")
    assert op3_pii_crf.find_personal(empty).count() == 0


def test_pii_long_runs_are_decoded_whole():
    field = op3_pii_crf.default_field()
    for dense in (True, False):
        for shift in range(250, 257):
            rng = random.Random(shift)
            fill = [str(rng.randint(10, 99)) if dense or k % 5 else "cats" for k in range(shift)]
            text = " ".join([*fill, "cats", "call", "(555)", "123-4567", "now", *fill, "call", "(555)", "123-4567", "and", *fill])
            got = op3_pii_crf.find_batch([text], field)[0]
            runs = op3_pii_crf.sequences(text)
            assert len(runs) == 1
            tags = [op3_pii_crf.TAGS[t] for t in field.decode([op3_pii_crf.features([text[a:b] for a, b in runs[0]])])[0]]
            paths = [t for p in op3_pii_crf.parts(text) for t in ([op3_pii_crf.TAGS[x] for x in field.decode([p])[0]][1 if p.lo else 0 :])]
            assert paths == tags
            assert [text[a:b] for k, a, b, *_ in got if k == "phone"] == ["(555) 123-4567"] * 2
    # Words without an end of the run between them: numbers alone.
    text = " ".join(["11"] * 255 + ["(555)", "123-4567"] + ["11"] * 300)
    assert len(op3_pii_crf.parts(text)) == 1
    assert op3_pii_crf.sequences("a" * 90 + "@b 1") and op3_pii_crf.sequences("x" * 100 + "7") == [[(0, 101)]]
    sizes = [1] * 2500 + [300_000, 400_000, 9_000_000]
    bounds = op3_pii_crf.batched(sizes)
    assert [k for a, b in bounds for k in range(a, b)] == list(range(len(sizes))) and all(b - a == 1 or (b - a) * sizes[b - 1] <= op3_pii_crf.BATCH for a, b in bounds)


def test_secret_rules_and_randomness(spark, empty):
    rows = [(1, None), (2, ""), (3, "é token=abc Secret : 'abcdefgh1' AKIAABCDEFGHIJKL12 😀 0123456789abcdef0123456789abcdef"), (4, "token=secret: abcdefgh12"), (5, "internationalization2000version and Xq9fK2mPz7Lw4TvB8nRc5YhJ here"), (6, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 abababababababababababab12"), (7, "api_key=abcdefgh api-key=abcdefgh " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1))
    got = {r["doc_id"]: [(s["kind"], s["s"], s["e"], s["found"]) for s in r["secrets"]] for r in op4_secrets.scan(df).collect()}
    rules = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    for i, t in rows:
        want = sorted(((m.start(), op4_secrets.KINDS.index(k), m.end()) for k, r, g, n in rules for m in re.finditer(r, t or "") if len(m[g]) >= n))
        assert [(s, op4_secrets.KINDS.index(k), e) for k, s, e, _ in got[i] if k != "random"] == want
    assert [x[3] for x in got[5]] == ["Xq9fK2mPz7Lw4TvB8nRc5YhJ"] and got[6] == []
    assert op4_secrets.scan(empty).count() == 0


def test_secrets_written_directly_after_an_equals_sign(spark):
    key, sig = "wJalrXUtnFEMI7K7MDENGbPxRfiCY2Zq", "Xq9fK2mPz7Lw4TvB8nRc5YhJ"
    rows = [(f"AWS_KEY={key}", key), (f"A=1\nDB_CRED={key}\nB=2", key), (f"https://x.y/z?sig={sig}&v=1", sig), (f"a=={sig}", sig), (f"x={sig}==", f"{sig}=="), (f"key: {key}", key)]
    df = spark.createDataFrame(rows, "text string, want string")
    for r in op4_secrets.scan(df).collect():
        assert [(x["kind"], x["found"], r["text"][x["s"] : x["e"]]) for x in r["secrets"]] == [("random", r["want"], r["want"])]


def test_secrets_of_many_kinds_and_ordinary_names(spark):
    rng = random.Random(7)
    b62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    names = ["user", "name", "get", "account", "by", "id", "table", "index", "http", "response", "utf8", "sha256", "v2", "data", "Internationalization", "cluster"]
    rows = [(f"b62-{n}", "".join(rng.choice(b62) for _ in range(n))) for n in (24, 32, 40) for _ in range(60)] + [("hex-30", "".join(rng.choice(b62[:10] + "abcdef") for _ in range(30))) for _ in range(60)]
    for _ in range(150):
        ws = [rng.choice(names) for _ in range(rng.randint(3, 7))]
        rows += [("camel", ws[0] + "".join(w.capitalize() for w in ws[1:]) + rng.choice(["", "10"])), ("snake", "_".join(ws)), ("path", "/" + "/".join(ws) + "/"), ("upper", "_".join(ws).upper()), ("dated", "-".join(ws) + "-2024-05-12"), ("digits", "".join(rng.choice("0123456789") for _ in range(16)))]
    df = spark.createDataFrame(rows, "kind string, text string").repartition(4)
    hit = F.avg(F.exists("secrets", lambda s: s["kind"] == "random").cast("int"))
    rate = {r["kind"]: r["rate"] for r in op4_secrets.scan(df).groupBy("kind").agg(hit.alias("rate")).collect()}
    # Longer tokens are found more often, ordinary names never, and no digit is needed.
    assert 0.75 < rate["b62-24"] <= rate["b62-32"] + 0.05 and rate["b62-40"] > 0.95 and rate["hex-30"] > 0.85
    assert max(rate[k] for k in ("camel", "snake", "path", "upper", "dated", "digits")) == 0
    one = spark.createDataFrame([("key: wJalrXUtnFEMIKbMDENGbPxRfiCYhZqJ", 1, 2)], "text string, secrets int, secrets_rules int")
    got = op4_secrets.scan(one).collect()[0]
    assert [s["kind"] for s in got["secrets"]] == ["random"] and (got["secrets_input"], got["secrets_rules"]) == (1, 2)
    ruled = op4_secrets.scan(spark.createDataFrame([("token=Xq9fK2mPz7Lw4TvB8nRc5YhJ token=password_of_user_name",)], "text string")).collect()[0]["secrets"]
    assert [(s["kind"], s["random"]) for s in ruled] == [("assign", True), ("assign", False)]


def plain_battery(token, alphabet, kinds):
    """The three p-values of a token by numpy: chi-squared, runs of several kinds, lag-1 correlation."""
    from math import erf, sqrt

    upper = lambda z: (1 - erf(z / sqrt(2))) / 2
    s = np.array([alphabet.index(c) for c in token], float)
    n, a = len(s), len(alphabet)
    chi = a / n * sum(int((s == v).sum()) ** 2 for v in set(s)) - n
    k = a - 1
    uniform = upper(((max(chi, 1e-9) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k)))
    c = [sum(x == y for x in kinds) for y in "0Aa"]
    m, two, three = len(kinds), sum(x * x for x in c), sum(x**3 for x in c)
    runs = 1 + sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    spread = (two * (two + m * (m + 1)) - 2 * m * three - m**3) / (m * m * (m - 1))
    p_runs = 0.0 if max(c) == m else 2 * upper(abs(runs - (m + 1 - two / m)) / sqrt(spread))
    d = s - s.mean()
    return uniform, p_runs, 2 * upper(abs((d[1:] * d[:-1]).sum() / (d * d).sum()) * sqrt(n))


def test_battery_matches_a_plain_one(spark):
    rng = random.Random(9)
    hexes, base62 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    tokens = [("".join(rng.choice(a) for _ in range(rng.randint(18, 60))), a) for a in (hexes, base62) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tokens)], "i int, token string").coalesce(1)
    for r in df.select("i", op4_secrets.battery(F.col("token")).alias("t")).collect():
        token, alphabet = tokens[r["i"]]
        kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" for c in token)
        assert [r["t"][k] for k in ("p_uniform", "p_runs", "p_serial")] == pytest.approx(plain_battery(token, alphabet, kinds), abs=1e-3)


def test_secret_places_of_many_matches(spark):
    text = " ".join(f"token={k:08d}x é" for k in range(500))
    got = op4_secrets.scan(spark.createDataFrame([(text,)], "text string")).collect()[0]["secrets"]
    want = [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]
    assert [(s["s"], s["e"]) for s in got] == want and len(want) == 500


def test_randomness_battery_separates(spark):
    rng = random.Random(5)
    rows = [(True, "".join(rng.choice("0123456789abcdef") for _ in range(31)))for _ in range(100)] + [(True, base64.b64encode(rng.randbytes(24)).decode()) for _ in range(100)]
    names = ["user", "name", "table", "index", "count", "value", "total", "first"]
    rows += [(False, "_".join(rng.choice(names) for _ in range(5)) + str(rng.randint(0, 99))) for _ in range(200)]
    df = spark.createDataFrame(rows, "secret boolean, text string")
    hit = op4_secrets.scan(df).select("secret", (F.size("secrets") > 0).alias("hit")).groupBy("secret").agg(F.avg(F.col("hit").cast("int")).alias("p")).collect()
    rate = {r["secret"]: r["p"] for r in hit}
    assert rate[True] > 0.85 and rate[False] < 0.03


def test_language_accuracy_and_edges(spark, empty):
    rng = random.Random(4)
    sounds = {"aa": ["the", "ing", "and", "wh", "tion"], "bb": ["sch", "ung", "der", "ein", "keit"], "cc": ["eau", "oi", "que", "ment", "les"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 200)))
    rows = [(i, make(lang), lang) for i in range(150) for lang in sounds]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, make("cc") * 50, None)]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    learned = op5_langid.fit(df.where("doc_id % 2 = 0"), dict_bytes=4000)
    assert set(learned) == set(sounds) and all(len(d) <= 4000 for d in learned.values())
    assert op5_langid.fit(df.where("doc_id % 2 = 0").repartition(7), dict_bytes=4000) == learned
    got = op5_langid.identify(df, learned).select("doc_id", "lang", "langid.*").collect()
    held = [g for g in got if g["doc_id"] % 2 == 1 and g["doc_id"] < 900]
    assert np.mean([g["lang"] == g["lang_pred"] for g in held]) > 0.97
    odd = {g["doc_id"]: g for g in got if g["doc_id"] >= 900}
    assert [odd[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"] and all(0 <= g["score"] <= 1 for g in got)
    assert op5_langid.fit(empty) == {} and op5_langid.identify(df, {}).where("langid.lang_pred <> 'und'").count() == 0


def test_language_is_scored_one_way_at_all_sizes(spark):
    """Against a plain compressor a language: each block with its copies, sizes summed, the smallest wins; and no jump at any length."""
    import zstandard as z

    rng = random.Random(14)
    sounds = {"aa": ["the", "ing", "and", "wh"], "bb": ["sch", "ung", "der", "keit"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    dicts = {lang: make(lang, 800).encode() for lang in sounds}
    c = op5_langid.Classifier(dicts)
    coders = {}
    for lang, raw in dicts.items():
        how = z.ZstdCompressionParameters.from_level(op5_langid.LEVEL, source_size=op5_langid.COPIES * (op5_langid.BLOCK_BYTES + 1), dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        coders[lang] = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)
    for lang in sounds:
        text = make(lang, 3000)
        for n in (20, 60, 255, 256, 257, 2000, 4096, 4097, len(text)):
            raw = text[:n].encode()
            size = {k: sum(len(x.compress((raw[i : i + 4096] + b"\n") * op5_langid.COPIES)) for i in range(0, len(raw), 4096)) for k, x in coders.items()}
            best, second = sorted(size.values())
            assert c(text[:n])[:2] == (min(size, key=lambda k: (size[k], k)), (second - best) / second) and c(text[:n])[0] == lang
        # Two more code points change each of the two sizes (of about 100 bytes) by no more than a few bytes.
        assert abs(c(text[:255])[1] - c(text[:257])[1]) < 0.05


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "some words here", "x")], "doc_id long, text string, LangID string").withColumn("pii", F.lit("y")).withColumn("decon", F.lit("z")).withColumn("decon_block_0", F.lit("b"))
    bench = spark.createDataFrame([("1", "some words")], "item_id string, text string")
    made = op9_decontamination.decontaminate(op3_pii_crf.find_personal(op5_langid.identify(df, {"en": b"some words of a language " * 9})), bench).collect()[0]
    assert (made["LangID_input"], made["pii_input"], made["decon_input"], made["decon_block_0"]) == ("x", "y", "z", "b")
    assert made["langid"]["lang_pred"] == "en" and made["pii"] == [] and made["decon"]["n_hit"] == 2 and not made["decon"]["whole"]


def plain_components(rows, k=4):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in op6_circulant_minhash.near_duplicates(docs, shingle=4).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)
    assert op6_circulant_minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in op6_circulant_minhash.near_duplicates(df, shingle=4).collect())
    assert got == sorted(plain_components(rows))


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    b = np.concatenate([a[:800], np.arange(200, dtype=np.uint64) + np.uint64(10**9)])
    s = op6_circulant_minhash.signature(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_telephony_round_trips_and_reference_values(spark, docs, empty):
    # Fixed points of the two companding laws, and a hand-decoded ADPCM block.
    assert op7_telephony.TABLES["mulaw"][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert op7_telephony.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    block = np.array([[0, 0, 0, 0, 0x70, 0x0F]], np.uint8)
    value, index, out = 0, 0, [0]
    for code in (0x0, 0x7, 0xF, 0x0):
        step = op7_telephony.STEPS[index]
        move = ((2 * (code & 7) + 1) * step) >> 3
        value = max(-32768, min(32767, value - move if code & 8 else value + move))
        index = max(0, min(88, index + op7_telephony.MOVES[code & 7]))
        out.append(value)
    assert op7_telephony.decode_ima(block)[0].tolist() == out
    for kind in op7_telephony.FORMATS:
        got = op7_telephony.load(op7_telephony.store(docs, kind=kind)).select("text", "media", "audio.*").collect()
        for r in got:
            raw = (r["text"] or "").encode()
            assert r["payload"] == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert len(r["pcm"]) == 2 * r["samples"]
            assert op7_telephony.unwav(bytes(r["media"]))[0] == kind
    clash = op7_telephony.load(op7_telephony.store(docs.withColumn("media", F.lit("m")).withColumn("Audio", F.lit("a"))))
    assert all((r["media_input"], r["Audio_input"]) == ("m", "a") and len(r["audio"]["pcm"]) == 2 * r["audio"]["samples"] for r in clash.collect())
    assert op7_telephony.load(op7_telephony.store(empty)).count() == 0
    assert op7_telephony.resample(np.array([0, 10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 10]


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Shares by weight, capped ones fixed and the excess shared again until none is above its cap."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, fixed = {s: weights[k % len(weights)] for k, s in enumerate(order)}, {}
    while len(fixed) < len(order):
        free = [s for s in order if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s: most * sizes[s] for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= over
    return fixed


def test_mixing_meets_targets(spark, empty):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 20, 300]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)] + [(9999, None, "d"), (3, "w w", "a"), (3, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = op8_mixing.mix_copies(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = plain_targets(sizes)
    assert target == pytest.approx(want) and sum(want.values()) <= sum(sizes.values()) + 1e-6
    for s in sizes:
        assert want[s] <= 3 * sizes[s] + 1e-9
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 1500)
    again = sorted((str(r["id"]), str(r["source"]), r["size"], r["copies"]) for r in op8_mixing.mix_copies(df.repartition(9)).collect())
    assert again == sorted((str(r["id"]), str(r["source"]), r["size"], r["copies"]) for r in got)
    assert op8_mixing.mix_copies(empty).count() == 0


def test_mixing_targets_reshare(spark):
    of = lambda rows: {r[0]: r[2] for r in op8_mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert of([("b", 10), ("a", 100), (None, 1000)]) == {"a": 300.0, "b": 30.0, None: 780.0}
    rng = random.Random(3)
    for _ in range(12):
        sizes = {(f"s{k}" if k else None): rng.choice([0, 1, 5, 100, 3000, rng.randint(0, 10**6)]) for k in range(rng.randint(1, 12))}
        assert of(list(sizes.items())) == pytest.approx(plain_targets(sizes))


def plain_mix(rows, seed=7):
    """Systematic sampling from plain lists: rows (id, source, hash, size) -> copies by (id, hash), with the offset of the nearest total."""
    targets = plain_targets({s: sum(n for _, t, _, n in rows if t == s) for s in {r[1] for r in rows}})
    out = {}
    for s, target in targets.items():
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[0]))
        rate = target / max(1, sum(r[3] for r in mine))
        out[s] = (rate, len(mine), target, mine)
    return out


def test_mixing_is_a_systematic_sample(spark):
    """Every document gets the floor or the ceiling of its rate, a source's copies are its rate times its documents to within one, and so at every size downwards."""
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 9, 40, 41, 700, 900])), rng.choice("aaab")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r["copies"] for r in op8_mixing.mix_copies(df).collect()}
    plain = plain_mix([(i, s, t, len(t.split())) for i, t, s in rows])
    for rate, n, target, mine in plain.values():
        assert all(got[r[0]] in (math.floor(rate), math.ceil(rate)) for r in mine)
        assert abs(sum(got[r[0]] for r in mine) - rate * n) < 1
        for size in {r[3] for r in mine}:
            above = [r for r in mine if r[3] >= size]
            assert abs(sum(got[r[0]] for r in above) - rate * len(above)) < 1 + 1e-6
        assert abs(sum(got[r[0]] * r[3] for r in mine) - target) < 900


def plain_hits(text, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = cut(text)
    hit, found = set(), set()
    for name, item in items:
        iw = cut(item)
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            piece = iw[i : i + window]
            for j in range(len(w) - len(piece) + 1):
                if w[j : j + len(piece)] == piece:
                    hit.update(range(j, j + len(piece)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, empty):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(9)] + ["été", "Über"]
    line = lambda a, b: [rng.choice(vocab) for _ in range(rng.randint(a, b))]
    items = [(f"{i}", " ".join(line(1, 30))) for i in range(25)] + [("25", None), ("26", ""), ("27", "Same, words!"), ("28", "same words"), (None, " ".join(line(15, 15)))]
    texts = []
    for _ in range(60):
        w = line(0, 60)
        for _ in range(rng.randint(0, 3)):
            piece = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(w))
            w[at:at] = piece[: rng.choice([len(piece), 13, 12])]
        texts.append(rng.choice([" ", "-", ", "]).join(w))
    texts += [None, "", "!!", "x" * 30_000 + " same words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    named = [(n or "", t) for n, t in items]
    for size in (1 << 18, 40):
        got = op9_decontamination.decontaminate(df, bench, block_windows=size).select("doc_id", "text", "decon.*").collect()
        for r in got:
            n, hit, found = plain_hits(r["text"], named)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert op9_decontamination.decontaminate(df, bench.limit(0)).where("decon.n_hit > 0").count() == 0
    assert op9_decontamination.decontaminate(empty, bench).count() == 0


def test_rollup_is_idempotent_and_additive(spark, docs, tmp_path):
    path = f"file://{tmp_path}/rollup"
    roll = op10_rollups.Rollup(spark, path)
    assert roll.totals().count() == 0
    by = (F.col("source"), F.col("lang"), F.lit("words-1"))
    n = op10_rollups.word_tokens(F.col("text"))
    roll.commit("a", op10_rollups.changes(docs, "insert", *by, n))
    once = sorted(map(str, roll.totals().collect()))
    roll.commit("a", op10_rollups.changes(docs, "insert", *by, n))
    assert sorted(map(str, roll.totals().collect())) == once
    gone, kept = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 or doc_id is null")
    roll.commit("b", op10_rollups.changes(gone, "delete", *by, n))
    roll.commit("c", op10_rollups.changes(kept, "revise", *by, n + 1, n))
    want = collections.Counter()
    for r in kept.collect():
        want[(r["source"], r["lang"], "docs")] += 1
        want[(r["source"], r["lang"], "tokens")] += len(words(r["text"])) + 1
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in roll.totals().collect()}
    assert all(got[k] == (want[(*k, "docs")], want[(*k, "tokens")]) for k in got)
    before = sorted(map(str, roll.totals().where("docs <> 0 or tokens <> 0").collect()))
    # A commit that fails leaves what stood before, and so does one of an unfinished batch.
    with pytest.raises(Exception, match="division|DIVIDE"):
        spark.conf.set("spark.sql.ansi.enabled", "true")
        roll.commit("b", op10_rollups.changes(docs.withColumn("n", F.expr("cast(1 / (doc_id - 4) as long)")), "insert", *by, F.col("n")))
    assert sorted(map(str, roll.totals().where("docs <> 0 or tokens <> 0").collect())) == before
    assert sorted(map(str, roll.compact().collect())) == before and roll.batches() == ["a", "b", "c"]
    # A folded batch counts once, however often it is sent; new ones count on top, before and after another folding.
    assert not roll.commit("a", op10_rollups.changes(docs, "insert", *by, n)) and sorted(map(str, roll.totals().collect())) == before
    assert roll.commit("d", op10_rollups.changes(docs.limit(3), "insert", *by, n))
    more = sorted(map(str, roll.totals().collect()))
    assert more != before and sorted(map(str, roll.compact().collect())) == more
    assert not roll.commit("d", op10_rollups.changes(docs, "insert", *by, n)) and sorted(map(str, roll.totals().collect())) == more
    with pytest.raises(ValueError):
        roll.commit("../x", docs)


def test_bpe_counts(spark):
    pytest.importorskip("public_tokenizers")
    count = op10_rollups.bpe_tokens(spark)
    rows = [("hello world",), ("",), (None,), ("<|endoftext|>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(count(F.col("text"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1


def test_digest_of_turns_follows_the_contract(spark):
    from tessera.llm import queries

    one = queries.op1_chat_windows(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert one["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert one["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and one["loss_chars"] == len(text)
