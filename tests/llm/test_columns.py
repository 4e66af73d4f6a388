"""Operators that judge rows one by one, and those that place them, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tonelake.llm import chat, common, decontamination, mixing, secrets, sharding, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def least_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    return next(c for c in range(sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(6))
def test_minimax_cuts(seed, monkeypatch):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 30, 500 if seed % 2 else 5]) for _ in range(rng.randrange(1, 80))]
    sums = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    shards, width = rng.randrange(2, 9), rng.choice([1, 7, 60])
    bins = {}
    for s in sums:
        bins.setdefault((s - 1) // width, []).append(s)
    b = sharding.Boundaries([(k * width, (k + 1) * width, min(v), max(v)) for k, v in bins.items()], sums[-1])
    for _ in range(200):
        capacity, cuts = sharding.minimax_cuts(b, shards, max(sizes))
        if not b.wanted:
            break
        b.load([(s - 1, s, s, s) for s in sums])
    ends = [0, *cuts, sums[-1]]
    assert capacity == least_capacity(sizes, shards)
    assert all(0 <= y - x <= capacity for x, y in zip(ends, ends[1:])) and set(cuts) <= {0, *sums}


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 8)
    rng = random.Random(3)
    texts = ["".join(rng.choices("aé ", k=rng.randrange(0, 90))) for _ in range(60)] + [None, "", "x" * 3000]
    rows = [(i, rng.choice(texts), "en", "s", 1) for i in range(300)] + [(1, "twice", "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "shard").withColumnRenamed("source", "_size")
    got = sharding.assign_shards(df).collect()
    assert sorted((r.doc_id, r.text or "\0") for r in got) == sorted((r[0], r[1] or "\0") for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r._size == len((r.text or "").encode()) + 1 and r._crc == (None if r.text is None else zlib.crc32(r.text.encode()))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    groups = {}
    for r in got:
        groups.setdefault(r.text, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values()) and set(by) <= set(range(16))
    size = {}
    for _, t, *_ in rows:
        size[t] = size.get(t, 0) + len((t or "").encode()) + 1
    order = sorted(size, key=lambda t: hashlib.sha256(b"\0" if t is None else t.encode()).digest())
    assert max(sum(r._size for r in v) for v in by.values()) <= least_capacity([size[t] for t in order], 16)


def test_shards_of_nothing(spark):
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_ordinal_regression(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("bcdfg", k=3))
    docs, labels = [], []
    for i in range(600):
        w, toxic = [word() for _ in range(rng.randrange(5, 60))], i % 4 == 0
        if toxic:
            w += rng.sample(["Zub", "zorg", "zit", "ZAP"], rng.randrange(1, 5))
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 1))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    docs += [(600, None, "en", "s", 1), (601, "", "en", "s", 1)]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(9999, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[i].toxic == (i % 4 == 0 and i < 600) for i in range(400, 602))
    one, four = ({i for i in range(0, 600, 4) if sum(z in docs[i][1] for z in ("Zub", "zorg", "zit", "ZAP")) == k} for k in (1, 4))
    mean = lambda ids: sum(got[i].expected_severity for i in ids) / len(ids)
    assert mean(one) + 0.5 < mean(four)
    left = toxicity.without_toxic(df, lab)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i in got if not got[i].toxic}
    empty = toxicity.fit(df, lab.limit(0))
    assert not any(r.toxic for r in toxicity.score(df, empty).collect())
    assert toxicity.score(df.limit(0), model).collect() == []


def plain_distance(a, b):
    row = [0] * (len(b) + 1)
    for k, x in enumerate(a):
        last, row[0] = row[0], k + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(0, 14))) for _ in range(2))
        n, end = decontamination.distance(a, b, decontamination._masks(a))
        assert n == plain_distance(a, b)


def test_leaks(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    items = [(k, text(rng.randrange(15, 60))) for k in range(30)]
    docs, leaked, far = [], {}, 0
    for i in range(240):
        k = rng.randrange(30)
        share = rng.choice([0, 0, 0.04, 0.09, 0.4])
        copy = decontamination.edited(items[k][1], int(share * len(items[k][1])), rng)
        if i % 3:
            docs.append((i, text(30) + "\n " + copy.upper().replace(" ", "  ") + " " + text(rng.randrange(0, 9))))
            if share < 0.1:
                leaked[i] = k
        else:
            docs.append((i, text(80)))
    docs += [(900, None), (901, ""), (902, " "), (903, items[0][1][:30]), (904, "the " * 20000)]
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (None, "a b c d e f g h")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}
    want = set(leaked.items())
    assert len(want - got) <= 0.05 * len(want)
    for i, k in got - want:
        assert plain_distance(decontamination.normal(items[k][1]), decontamination.normal(dict(docs)[i])) <= 0.1 * len(items[k][1])
    assert decontamination.leaks(df, bench.limit(0)).collect() == []
    assert decontamination.leaks(df.limit(0), bench).collect() == []
    kept = {r.doc_id for r in decontamination.without_leaks(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 4)
    items = [(k, f"item number{k} asks whether sentence{k * 37} holds for question{k * 91}") for k in range(9)]
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    got = decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.edit_distance == 0} == {(k, k) for k in range(9)}


def test_pfair_schedule():
    rng = random.Random(6)
    for _ in range(20):
        blocks = {f"s{k}": rng.randrange(0, 900) for k in range(rng.randrange(1, 7))}
        weights = {s: rng.random() + 0.01 for s in blocks}
        phases, periods = mixing.schedule(blocks, weights)
        table = {(s, p, r): x for s, p, r, x in periods}
        slots = []
        for s, p, first, end, start, period, per in phases:
            slots += [(start + k // per * period + table[s, p, k % per], s, p, per / period, start) for k in range(end - first)]
        slots.sort()
        assert [x[0] for x in slots] == list(range(sum(blocks.values())))
        assert {s: sum(x[1] == s for x in slots) for s in blocks} == blocks
        seen: dict = {}
        for slot, s, p, share, start in slots:
            seen[s, p] = seen.get((s, p), 0) + 1
            assert abs(seen[s, p] - share * (slot + 1 - start)) < 1


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(0, 400), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(400)] + [(400, None, "en", "a", 1), (7, "x", "en", "a", 1), (7, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "slot")
    got = mixing.mix(df, {"a": 1.0, "b": 1.0, "c": 2.0}, block_bytes=500).collect()
    assert len(got) == len(rows)
    where = {}
    for r in got:
        assert where.setdefault((r.source, r.block), r.slot) == r.slot
    assert len(set(where.values())) == len(where)
    early = [r.source for r in sorted(got, key=lambda r: r.slot) if r.slot < 40]
    assert early.count("c") > early.count("a") / 3
    assert mixing.mix(df.limit(0)).collect() == []
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, df.collect()))
    pooled = mixing.mix(spark.range(600).selectExpr("id as doc_id", "'t' as text", "string(id) as source"))
    assert pooled.count() == 600


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/ x\n", "same"), (2, None, None), (5, "u", ""), (9, "u", "é" * 50000), (None, "n", "same"), (4, "v", "own"), (4, "v", "own"), (-8, "m", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, u, h in rows:
        data = (h or "").encode()
        r = next(x for k, x in by.items() if k[0] == i)
        revisit = i is not None and first[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload == (None if revisit else data)
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/none").collect() == []


def test_broken_archives():
    record = warc.encode_record(1, "u", b"payload", None, False)
    assert warc.decode_record(record)["payload"] == b"payload"
    for bad in (record[:-5] + record[-4:], record.replace(b"payload", b"paYload"), record.replace(b"WARC-Type", b"WARC-Kind"), record[:40]):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)
    import zstandard

    archive = warc.dictionary_frame(b"") + zstandard.ZstdCompressor().compress(record)
    assert [r for _, r in warc.decode_archive(archive)] == [record]
    with pytest.raises(warc.WarcError):
        list(warc.decode_archive(archive[:-3]))


def test_secrets(spark):
    rng = random.Random(3)
    key = secrets.random_strings(8)
    rows = [(i, " ".join("".join(rng.choices("aeiourstln", weights=[9, 12, 8, 7, 3, 6, 6, 9, 4, 7], k=rng.randrange(2, 24))) for _ in range(80)), "en", "s", 1) for i in range(60)]
    rows += [(100, f"see {key[0]} there", "", "", 1), (101, "Api_Key = 'abcdefgh1'", "", "", 1), (102, "password=short token: long.enough=", "", "", 1), (103, None, "", "", 1), (104, "", "", "", 1)]
    rows += [(105, "ÉAKIA" + "A" * 12 + " " + "0f" * 16 + "g", "", "", 1), (106, f"secret: {key[1]}", "", "", 1), (107, "paſſword=abcdefghi", "", "", 1)]
    df = spark.createDataFrame(rows, DOCS)
    model = secrets.train(df)
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.found] for r in secrets.scan(df, model).collect()}
    assert got[100] == [("markov", 4, 4 + len(key[0]))]
    assert got[101] == [("assign", 0, 20)] and got[102] == [("assign", 15, 34)]
    assert got[103] == got[104] == got[107] == []
    assert got[105] == [("access", 1, 17), ("hex", 18, 50)]
    assert [k for k, _, _ in got[106]] == ["assign"]
    assert not any(got[i] for i in range(60))
    assert all(f.ratio > 0 for r in secrets.scan(df, model).collect() for f in r.found if f.kind != "assign" or r.doc_id == 106)


def test_secrets_of_other_seeds(spark):
    """Planted keys that no base pattern matches, made apart from those trained on, among words and identifiers."""
    rng = random.Random(8)
    syllables = ["ta", "ri", "con", "sel", "mo", "ver", "ding", "pre", "lu", "est", "in", "for", "ma", "tion", "get", "set"]
    word = lambda n: "".join(rng.choices(syllables, k=n))
    plain = lambda: rng.choice([word(rng.randrange(1, 7)), word(2).upper() + "_" + word(2).upper(), word(2) + word(2).title() + word(2).title(), word(3) + "-" + word(3), str(rng.randrange(10**15)), word(2) + "/" + word(3)])
    keys = [k for k in secrets.random_strings(400, seed=91) if not secrets.base_spans(k)]
    rows, planted = [], {}
    for i in range(800):
        words = [plain() for _ in range(60)]
        if i % 2:
            planted[i] = keys[i // 2 % len(keys)]
            words.insert(rng.randrange(60), planted[i])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, f.text) for r in secrets.scan(df, secrets.train(df)).collect() for f in r.found if f.kind == "markov"}
    right = got & set(planted.items())
    assert len(right) >= 0.98 * len(planted) and len(right) >= 0.98 * len(got)


def plain_base(text):
    """The base rule, letter by letter as it is given."""
    word = "[A-Za-z0-9+/_.=-]"
    either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?({word}+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def test_base_columns_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in secrets.op6(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = plain_base(text)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for x, _, _ in base) for k in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("markov")] == joined.split(",") * bool(base)


def test_secrets_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, found int")
    model = secrets.train(empty)
    assert secrets.scan(empty, model).collect() == []
    long = "token: abcdefgh12 " * 30_000
    start = time.monotonic()
    assert len(secrets.scan_text(long, model)) == 30_000 and time.monotonic() - start < 20
    clash = spark.createDataFrame([(1, "AKIA" + "B" * 20, "x")], "doc_id long, text string, found string")
    assert [f.kind for f in secrets.scan(clash, model).first().found] == ["access"]


def test_escapes():
    rng = random.Random(5)
    bits = ["<", "|", "\\", "[", "INST]", "/", "s>", "/INST]", "<|turn|>", "<|end|>", "\n", "</s>", "SYS>>", "<|text|>", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(x in out for x in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))
        assert chat.read_segment(chat.format_turn("us<|er", [{"type": "text", "text": text}])["segment"]) == ("us<|er", text)
    with pytest.raises(ValueError):
        chat.read_segment("<|turn|>a<|text|>b<|end|>c<|end|>\n")


def test_parts(spark):
    parts = [("text", "look <|image|> ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, None, None, None, None, 3), None, ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (None, None, None, [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = {r.turn: r for r in chat.format_turns(df).collect()}
    a = rows[0]
    assert a.segment == "<|turn|>user<|text|>look <\\|image|> <|image|><|audio|><|document|><|end|>\n"
    assert [(x.type, x.ref, x.tokens) for x in a.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", None, 1536)]
    assert all(a.segment[x.at :].startswith(f"<|{x.type}|>") for x in a.attachments)
    assert a.expanded_tokens == a.text_tokens + 3 + 63 + 1536 and a.loss_start is None
    assert rows[1].segment[rows[1].loss_start : rows[1].loss_end] == ""
    back = chat.read_conversations(chat.format_turns(df)).collect()
    assert {r.conv_id: r.n_turns for r in back} == {1: 2, None: 1}
    assert chat.read_conversations(chat.format_turns(df.limit(0))).collect() == []


def test_sizes_that_are_no_numbers(spark):
    bad = [("audio", None, "a", None, None, s, None) for s in (float("nan"), float("inf"), -1.0)] + [("image", None, "b", -5, -5, None, None), ("document", None, "c", None, None, None, -3), ("other", "x", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", bad, "clash")], f"conv_id long, turn long, role string, parts array<{chat.PART}>, segment string")
    assert [a.tokens for a in chat.format_turns(df).first().attachments] == [1] * 5
    long = "[INST] " * 200_000
    assert chat.unescape(chat.escape(long)) == long


def test_pieces():
    texts = ["x" * 10, None, "y" * (common.PIECE_BYTES + 5), "z"] + ["w"] * 1200
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    out = list(common.pieces([batch, batch.slice(0, 0)]))
    assert [t for b in out for t in b.column("text").to_pylist()] == texts
    assert all(b.num_rows <= common.PIECE_ROWS for b in out) and any(b.num_rows == 1 for b in out)


@pytest.fixture(scope="module")
def counts():
    return token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))


def test_edited_counts(counts):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(["a", "ll", "'", "s", " ", "  ", "\n", "9", "é", ".", "re", " the", "l"], k=rng.randrange(0, 60)))
        tree = token_counts.TokenTree(text, counts.__getitem__, leaf=rng.choice([1, 2, 4]))
        for _ in range(4):
            start = rng.randrange(0, len(text) + 1)
            end, new = rng.randrange(start, min(len(text), start + 8) + 1), "".join(rng.choices(["a", "'", "l", " ", "\n", "re"], k=rng.randrange(0, 4)))
            text = text[:start] + new + text[end:]
            tree.edit(start, end, new)
            assert tree.text == text and tree.total == len(counts.encoding.encode_ordinary(text))


def test_edits_read_little(counts):
    text = " ".join(f"word{k}" for k in range(5000))
    tree = token_counts.TokenTree(text, counts.__getitem__)
    tree.edit(9000, 9003, "X")
    assert 0 < tree.encoded < 200


def test_redaction_counts(spark, counts):
    rows = [(1, "write to a.b@mail.org or 555-123 4567 now"), (2, None), (3, ""), (4, "AKIA" + "Z" * 16), (4, "plain"), (None, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, token_counts.edit_counts(df, token_counts.redactions).select("doc_id", "n_tokens", "n_edits", "n_tokens_after").collect()), key=str)
    want = []
    for i, t in rows:
        t = after = t or ""
        edits = token_counts.redactions(t)
        for s, e, new in sorted(edits, reverse=True):
            after = after[:s] + new + after[e:]
        want.append((i, len(counts.encoding.encode_ordinary(t)), len(edits), len(counts.encoding.encode_ordinary(after))))
    assert got == sorted(want, key=str)


def test_trees_as_a_table(spark, counts, tmp_path):
    rng = random.Random(4)
    texts = {i: "".join(rng.choices(["a", "ll", "'", " ", "  ", "\n", "9", "é", ".", " the", "word"], k=rng.randrange(0, 900))) for i in range(30)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(90, None, 1), (0, texts[0], 1), (None, "no id", 1)], "doc_id long, text string, leaf int")
    token_counts.trees(docs).write.parquet(f"{tmp_path}/0")
    leaves = spark.read.parquet(f"{tmp_path}/0")
    texts |= {90: "", None: "no id"}
    for turn in range(1, 4):
        edits, after = [], dict(texts)
        for i in rng.sample(range(30), 12) + [90]:
            at = 0
            for _ in range(rng.randrange(1, 4)):
                start = at + rng.randrange(0, 30)
                end = start + rng.randrange(0, 9)
                if end > len(texts[i]):
                    break
                edits.append((i, start, end, rng.choice(["", "x", " the", "'ll", "\n\n", "long " * 200])))
                at = end + 1
            for _, s, e, new in sorted((x for x in edits if x[0] == i), reverse=True):
                after[i] = after[i][:s] + new + after[i][e:]
        edits += [(3, 10**6, 10**6 + 1, "far"), (None, 0, 0, "x"), (777, 0, 0, "x")]
        token_counts.edit_trees(leaves, spark.createDataFrame(edits, "doc_id long, start long, end long, new string")).write.parquet(f"{tmp_path}/{turn}")
        leaves, texts = spark.read.parquet(f"{tmp_path}/{turn}"), after
        got: dict = {}
        for r in sorted(leaves.collect(), key=lambda r: r.leaf):
            got[r.doc_id] = got.get(r.doc_id, "") + r.text
        assert got == texts
        assert {r.doc_id: (r.chars, r.n_tokens) for r in token_counts.totals(leaves).collect()} == {i: (len(t), len(counts.encoding.encode_ordinary(t))) for i, t in texts.items()}
    assert token_counts.trees(docs.limit(0)).collect() == []
    assert token_counts.edit_counts(docs.limit(0), token_counts.redactions).collect() == []


def test_long_items():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghij klmn", k=n))
    item = decontamination.normal(text(5_000))
    index = decontamination.Index([(1, item)])
    assert index.bits.nbytes <= decontamination.STEPS * decontamination.WALKS * 256
    texts = [text(500) + decontamination.edited(item, 300, rng) + text(500), text(9_000)]
    assert [(d, k) for d, k, n, _ in index.matches(texts, index.places(texts)) if n <= 500] == [(0, 0)]


def test_windows_stay_within_their_bytes():
    sizes = np.array([1, 1, 5, 900, 1000, 4000, 10**6])
    out = list(decontamination.parts(sizes, 4000))
    assert [i for s in out for i in range(s.start, s.stop)] == list(range(7))
    assert all(s.stop - s.start == 1 or sizes[s.stop - 1] * (s.stop - s.start) <= 4000 for s in out)


def plain_ordinal(rows, grades, features):
    """The gradient of the penalised likelihood of the cumulative-link model by differences."""

    def loss(w, theta):
        total = 0.5 * toxicity.L2 * sum(x * x for x in w)
        edge = [-math.inf, *theta, math.inf]
        for bag, g in zip(rows, grades, strict=True):
            s = sum(w[k] for k in bag)
            cdf = [0 if e == -math.inf else 1 if e == math.inf else 1 / (1 + math.exp(s - e)) for e in edge]
            total -= math.log(cdf[g + 1] - cdf[g]) / len(grades)
        return total

    return loss


def test_ordinal_fit_is_the_optimum():
    rng = random.Random(5)
    rows = [sorted(rng.sample(range(6), rng.randrange(0, 5))) for _ in range(160)]
    grades = np.array([min(3, max(0, sum(k < 3 for k in bag) + rng.choice([-1, 0, 0, 1]))) for bag in rows])
    at = [(i, k) for i, bag in enumerate(rows) for k in bag]
    w, theta = toxicity.fit_ordinal(np.array([a for a, _ in at]), np.array([k for _, k in at]), grades, 6)
    loss = plain_ordinal(rows, grades.tolist(), 6)
    best = loss(w, theta)
    for k in range(9):
        for h in (-0.05, 0.05):
            w2, t2 = w.copy(), theta.copy()
            (w2 if k < 6 else t2)[k if k < 6 else k - 6] += h
            assert loss(w2, t2) > best - 1e-5
    assert list(theta) == sorted(theta)


def test_ordinal_score_is_the_sum_of_exceedances(spark):
    model = toxicity.OrdinalModel({"bad": 1.5, "worse": 2.25, "fine": -1.0}, (0.5, 2.0, 3.5))
    rows = [(1, "Bad and worse!"), (2, "fine, bad"), (3, None), (4, ""), (5, "worse " * 100_000), (5, "bad"), (None, "bad")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, toxic int, severity int")
    got = sorted(map(tuple, toxicity.score(df, model).collect()), key=str)
    want = []
    for i, text in rows:
        words = set(re.findall(r"[a-z]+", (text or "").lower()))
        s = sum(v for k, v in model.weights.items() if k in words)
        p = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        want.append((i, sum(p), sum(x >= 0.5 for x in p), sum(p) >= toxicity.REJECT))
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[0] == x[0] and abs(g[1] - x[1]) < 1e-12 and g[2:] == x[2:]
