import collections
import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossgrid.llm import chat, progressive_jpeg, warc

from .fixtures import documents, table

# chat

PIECES = st.sampled_from(["<", "s>", "</s>", "<s>", "\\", "[INST]", "[/INST]", "[", "/", "<|image|>", "<\\s>", " ok ", "\n", "é"])


@given(st.lists(PIECES, max_size=8).map("".join), st.lists(PIECES, max_size=4).map("".join))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    whole = chat.turn(role, chat.escape(text)) + chat.turn("assistant", "x")
    assert [(r, t) for r, t, _ in chat.read_turns(whole)] == [(role, text), ("assistant", "x")]


def test_parts_are_flattened_in_order():
    f = chat.flatten([{"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 15}, {"kind": "audio", "ref": "b.wav", "seconds": 2.0}, None, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"text": "<|image|>"}])
    text = "".join(f.text)
    assert text == "see <|image|><|audio|><|document|><\\|image|>"
    assert [(a.kind, a.ref, a.tokens) for a in f.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 768)]
    assert all(text[a.position :].startswith(f"<|{a.kind}|>") for a in f.attachments)
    with pytest.raises(ValueError):
        chat.flatten([{"kind": "video"}])


def test_chat_report(spark):
    rows = [(1, 1, "assistant", "b </s> \\"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, None, "x"), (None, 0, "assistant", "lone"), (1, 2, "assistant", "[INST]"), (1, 2, "assistant", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": F.lit(1), "n_turns": F.lit("clash")})
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat.conversations(chat.format_turns(df, chat.text_parts())).collect()}
    for c, r in whole.items():
        assert len(r.formatted) == got[c].formatted_chars
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == "".join(t for _, q, t in by[c] if q == "assistant")
    assert chat.chat_report(df.limit(0)).count() == 0
    assert all((r.n_attachments, r.attached_tokens, r.attachments_sha256) == (0, 0, hashlib.sha256(b"").hexdigest()) for r in got.values())


def test_chat_report_of_typed_parts(spark):
    text = {"kind": "text", "text": "see </s> "}
    image, sound, paper = {"kind": "image", "ref": "a.png", "width": 28, "height": 15}, {"kind": "audio", "ref": "b.wav", "seconds": 2.0}, {"kind": "document", "pages": 3}
    rows = [(1, 1, "assistant", [text, image, text, sound]), (1, 0, "user", [paper, image]), (1, 2, "user", None), (2, 0, "user", [text, None]), (2, 1, "user", [sound]), (2, 1, "user", [sound])]
    df = spark.createDataFrame([(c, t, r, p and [x and tuple(x.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages")) for x in p]) for c, t, r, p in rows], f"conv_id long, turn long, role string, body {chat.PARTS}")
    got = {r.conv_id: r for r in chat.chat_report(df, F.col("body")).collect()}
    whole = {r.conv_id: r for r in chat.conversations(chat.format_turns(df, F.col("body"))).collect()}
    assert [(got[c].n_attachments, got[c].attached_tokens) for c in (1, 2)] == [(4, 768 + 4 + 4 + 50), (2, 100)]
    for c, r in whole.items():
        assert all(r.formatted[a.position :].startswith(f"<|{a.kind}|>") for a in r.attachments)
        lines = "".join(f"{a.kind} {a.position} {a.tokens} {a.ref}\n" for a in r.attachments)
        assert got[c].attachments_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[c].n_attachments, got[c].attached_tokens, got[c].formatted_chars) == (len(r.attachments), r.attached_tokens, len(r.formatted))


# archives


@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(sorted), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc(spark):
    r = random.Random(1)
    html = [None, "", "<p>a</p>", "<p>a</p>", "with\r\n\r\nblank lines\r\n\r\n", "é" * 50, "WARC/1.1\r\n\r\n", "x" * 200_000]
    rows = [(k, r.choice(["http://www.B.example/x#f", "https://a.example:8080/y?q", None, "http://a.example/y"]), r.choice(html)) for k in range(60)] + [(7, "http://twice.example/", "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "first": F.lit("clash")})
    got = warc.index_archives(spark, warc.write_archives(df)).collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, h in sorted(rows, key=lambda x: x[0]):
        first.setdefault(h or "", k)
    by = collections.defaultdict(list)
    for x in got:
        by[x.page_id].append(x)
    for k, url, h in rows:
        assert any((x.payload_bytes, x.payload_digest) == (len((h or "").encode()), warc.digest32((h or "").encode())) and (x.record_type, x.refers_to) == (("response", None) if first[h or ""] == k else ("revisit", first[h or ""])) for x in by[k]), k
    keys = [(x.url_key, x.ts, x.page_id) for x in got]
    assert keys == sorted(keys)
    assert warc.url_key("http://www.B.example:80/X?q=1#z") == "example,b)/x?q=1"
    assert warc.index_archives(spark, warc.write_archives(df.limit(0))).count() == 0
    nobody = spark.createDataFrame([(None, "http://a.b/", "same"), (7, "http://a.b/", "same"), (None, "http://a.b/", "own"), (None, "http://a.b/", "own"), (-5, None, None)], "page_id long, url string, html string")
    index = warc.index_archives(spark, warc.write_archives(nobody)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in index), key=str) == sorted([(None, 4, "revisit", 7), (7, 4, "response", None), (None, 3, "response", None), (None, 3, "response", None), (-5, 0, "response", None)], key=str)
    assert [r.page_id for r in index][-3:] == [None] * 3


# progressive JPEG


def scans(coef, al):
    """A file of one component with zeros in it: DC, two AC bands first and refined, by the plain rules of the format."""
    n = len(coef)
    bits = []

    def put(value, length):
        bits.extend((value >> (length - 1 - i)) & 1 for i in range(length))

    def flush():
        data = progressive_jpeg._entropy(np.array(bits, np.uint8))
        bits.clear()
        return data

    symbols = list(range(256))[:255]
    table_ = lambda c: progressive_jpeg._segment(progressive_jpeg.DHT, bytes([c, *[0] * 7, 255, *[0] * 8, *symbols]))
    out = [b"\xff\xd8", progressive_jpeg._segment(progressive_jpeg.DQT, b"\0" + bytes(range(1, 65))), progressive_jpeg._segment(progressive_jpeg.SOF2, bytes([8, 0, 8, 0, 8 * n, 1, 1, 0x11, 0])), table_(0), table_(0x10)]

    def number(v):
        size = int(abs(v)).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    last = 0
    for b in coef:
        v = int(b[0]) >> al
        size, x = number(v - last)
        put(size, 8)
        put(x, size)
        last = v
    out += [progressive_jpeg._scan_head([(1, 0)], 0, 0, 0, al), flush()]
    shifted = np.sign(coef) * (np.abs(coef) >> al)
    for ss, se in ((1, 5), (6, 63)):
        for b in shifted:
            run, k = 0, ss
            end = max([i for i in range(ss, se + 1) if b[i]], default=ss - 1)
            while k <= end:
                if not b[k]:
                    run += 1
                elif run > 15:
                    put(0xF0, 8)
                    run -= 16
                    continue
                else:
                    size, x = number(int(b[k]))
                    put(run << 4 | size, 8)
                    put(x, size)
                    run = 0
                k += 1
            if end < se:
                put(0, 8)
        out += [progressive_jpeg._scan_head([(1, 0)], ss, se, 0, al), flush()]
    for low in range(al - 1, -1, -1):
        for b in coef:
            put(int(b[0]) >> low & 1, 1)
        out += [progressive_jpeg._scan_head([(1, 0)], 0, 0, low + 1, low), flush()]
        for ss, se in ((1, 5), (6, 63)):
            for b in coef:
                mag = np.abs(b) >> low
                run, held = 0, []
                end = max([i for i in range(ss, se + 1) if mag[i] == 1], default=ss - 1)
                for k in range(ss, end + 1):
                    if mag[k] == 0:
                        run += 1
                        if run == 16:
                            put(0xF0, 8)
                            for x in held:
                                put(x, 1)
                            run, held = 0, []
                    elif mag[k] > 1:
                        held.append(int(mag[k]) & 1)
                    else:
                        put(run << 4 | 1, 8)
                        put(int(b[k] > 0), 1)
                        for x in held:
                            put(x, 1)
                        run, held = 0, []
                rest = held + [int(mag[k]) & 1 for k in range(end + 1, se + 1) if mag[k] > 1]
                if end < se or rest:
                    put(0, 8)
                    for x in rest:
                        put(x, 1)
            out += [progressive_jpeg._scan_head([(1, 0)], ss, se, low + 1, low), flush()]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("al", [0, 1, 2])
def test_decoder_reads_scans_with_zeros(al):
    r = np.random.default_rng(al)
    coef = np.where(r.random((6, 64)) < 0.25, r.integers(-90, 91, (6, 64)), 0)
    image = progressive_jpeg.Image(scans(coef, al))
    assert (image.components[1].coef == coef).all()
    x = np.zeros((6, 64))
    x[:, progressive_jpeg.ZIGZAG] = coef * np.arange(1, 65)
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    want = np.concatenate([c.T @ b.reshape(8, 8) @ c for b in x], 1) + 128
    assert np.abs(np.clip(np.round(want), 0, 255) - image.planes()[0]).max() <= 1


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_payloads_come_back(raw):
    payload = progressive_jpeg.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0
    image = progressive_jpeg.Image(progressive_jpeg.encode(payload, len(raw)))
    assert progressive_jpeg.payload_of(image) == (payload, len(raw))
    assert image.rgb().shape == (image.height, image.width, 3)


def plain_rgb(image):
    """Samples by the definition of the transform, chroma doubled and colours converted pixel by pixel."""
    planes = []
    for c in image.components.values():
        out = np.zeros((8 * c.rows, 8 * c.cols))
        u = np.arange(8)
        basis = np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
        for b, coef in enumerate(c.coef):
            square = np.zeros(64)
            square[progressive_jpeg.ZIGZAG] = coef
            i, j = divmod(b, c.cols)
            out[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
        planes.append(np.clip(np.floor(out + 0.5), 0, 255))
    rgb = np.zeros((image.height, image.width, 3))
    for y in range(image.height):
        for x in range(image.width):
            light, blue, red = planes[0][y, x], planes[1][y // 2, x // 2] - 128, planes[2][y // 2, x // 2] - 128
            rgb[y, x] = light + 1.402 * red, light - 0.344136 * blue - 0.714136 * red, light + 1.772 * blue
    return np.clip(np.floor(rgb + 0.5), 0, 255)


@pytest.mark.parametrize("size", [1, 64, 700, 2500])
def test_tensors_by_the_definition(spark, size):
    raw = np.random.default_rng(size).integers(97, 123, size, dtype=np.uint8).tobytes()
    payload = progressive_jpeg.padded(raw)
    image = progressive_jpeg.Image(progressive_jpeg.encode(payload, len(raw)))
    rgb, want = image.rgb(), plain_rgb(image)
    # a sample that rounds the other way moves a colour by 1.772 at most, and two by 3
    apart = np.abs(rgb - want)
    assert apart.max() <= 4 and (apart > 0).mean() < 0.01
    mean = rgb.astype(float).reshape(-1, 3).mean(0)
    shape, means, digest = progressive_jpeg.feature(rgb).split(";")
    assert shape == f"{image.height}x{image.width}" and digest == f"{zlib.crc32(rgb.tobytes()):08x}"
    assert np.abs(np.array(means.split(","), float) - mean).max() < 1e-3
    rows = spark.createDataFrame([(1, raw.decode()), (2, None)], "doc_id long, text string")
    media = progressive_jpeg.store(rows, ["doc_id"]).withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")))
    got = {r.doc_id: r for r in progressive_jpeg.decode_rgb(media, ["doc_id"]).collect()}
    assert (np.frombuffer(got[1].rgb, np.uint8).reshape(got[1].height, got[1].width, 3) == rgb).all()
    assert got[2].rgb is None and got[2].height is None


def test_media_report(spark):
    got = progressive_jpeg.media_report(table(spark)).collect()
    rows = documents()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, text, *_ in rows:
        raw = (text or "").encode()
        payload = progressive_jpeg.padded(raw)
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[0].media_sha256 == by[1].media_sha256 and by[0].feature == by[1].feature
    assert progressive_jpeg.media_report(table(spark, [])).count() == 0
    rgb = progressive_jpeg.decode_rgb(progressive_jpeg.store(table(spark, rows[:3]).drop("ids"), ["doc_id"]), ["doc_id"]).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in rgb)


# the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns, name
        have, left = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= have
        if name == "quality_classifier":
            good = [k for k in have if k in labels and labels[k].quality == 1 and not labels[k].toxic]
            assert sum(k in left for k in good) >= 0.97 * len(good)
        if name == "substring_dedup":
            assert left == have
        docs = out.persist()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [k for k, _ in groupby(n for n, _ in corpus_pipeline.STAGES)] == ["quality_rules", "quality_classifier", "near_duplicates", "substring_dedup", "packing"]


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the operators' own names pass all stages; an empty table gives no pieces."""
    import corpus_pipeline

    from .fixtures import documents, table

    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(20, 50)] + [(None, 1, 0), (22, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = {"kept": "_q_n_words", "component_id": "_order", "ids": "_n_words"}
    docs = table(spark).withColumnsRenamed(names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    docs = docs.persist()
    left = [r.doc_id for r in docs.collect()]
    assert not {1, 2, 3, 4, 5, 6, 7, 8, 14, 16} & set(left) and len(set(left) & set(range(20, 60))) >= 30
    assert left.count(23) in (0, 3)  # the row that is there three times
    assert {r._order for r in docs.collect()} == {"y"}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(left)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == set(left)
    none = f"{tmp_path}/none"
    labels.write.parquet(f"{none}/labels.parquet")
    table(spark, []).withColumnsRenamed(names).write.parquet(f"{none}/documents.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
