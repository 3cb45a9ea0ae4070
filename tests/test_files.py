"""Page files of every format and depth, planned by bytes; files, archives; split shards."""

import json
import struct
import subprocess
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.sources import decoders as D
from folioscope.sources import files as X
from folioscope.sources import pages as I

RNG = np.random.default_rng(4)


def loop_unfilter(raw, unit):
    """The five filters, a byte at a time."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1), np.uint8)
    for y in range(raw.shape[0]):
        for x in range(raw.shape[1] - 1):
            a, c = (int(out[y + 1, x - unit]), int(out[y, x - unit])) if x >= unit else (0, 0)
            b = int(out[y, x])
            best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[y + 1, x] = (int(raw[y, x + 1]) + (0, a, b, (a + b) // 2, best)[raw[y, 0]]) & 255
    return out[1:]


@pytest.mark.parametrize("kinds", [[0, 1, 2, 3, 4], [4], [3], [0, 2], [1]])
@pytest.mark.parametrize(("h", "w", "unit"), [(1, 1, 1), (5, 7, 1), (9, 3, 3), (30, 40, 2), (3, 50, 6), (40, 2, 4)])
def test_filters_equal_a_loop(h, w, unit, kinds):
    raw = RNG.integers(0, 256, (h, 1 + w * unit), dtype=np.uint8)
    raw[:, 0] = RNG.choice(kinds, h)
    assert (D.unfilter(raw, unit) == loop_unfilter(raw, unit)).all()


def packed(px, depth):
    """Lines of values as lines of bytes."""
    h, w = px.shape
    if depth == 16:
        return px.astype(">u2").view(np.uint8).reshape(h, -1)
    if depth == 8:
        return px.astype(np.uint8)
    wide = np.zeros((h, -(-w * depth // 8) * 8 // depth), np.uint8)
    wide[:, :w] = px
    return np.packbits(np.unpackbits(wide[:, :, None], axis=2)[:, :, 8 - depth :].reshape(h, -1), axis=1)


def png(px, depth, kind, lace=0, palette=None, filters=(0,), dpi=None):
    """A PNG of (h, w, bands) values, unfiltered lines but for the filters asked for, which are applied by brute force."""
    h, w, bands = px.shape
    unit, body = max(1, bands * depth // 8), b""
    for y, x, dy, dx in D.PASSES if lace else ((0, 0, 1, 1),):
        part = px[y::dy, x::dx]
        if not part.size:
            continue
        lines = packed(part.reshape(len(part), -1), depth)
        before = np.zeros(lines.shape[1], np.uint8)
        for i, line in enumerate(lines):
            f = filters[i % len(filters)]
            left, corner = (np.concatenate([np.zeros(unit, np.uint8), v[:-unit]]) if len(v) > unit else np.zeros_like(v) for v in (line, before))
            a, b, c = (v.astype(int) for v in (left, before, corner))
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = (0 * a, a, b, (a + b) // 2, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)))[f]
            body += bytes([f]) + ((line.astype(int) - guess) & 255).astype(np.uint8).tobytes()
            before = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    more = (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + (chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)) if dpi else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace)) + more + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("lace", [0, 1])
@pytest.mark.parametrize(("h", "w"), [(1, 1), (3, 2), (13, 21)])
def test_png_of_every_kind(lace, h, w):
    for depth in (1, 2, 4, 8, 16):
        top = (1 << depth) - 1
        px = RNG.integers(0, top + 1, (h, w, 1))
        want = (px >> 8 if depth == 16 else px * (255 // top))[:, :, 0]
        assert (D.decode_png(png(px, depth, 0, lace, filters=(0, 1, 2, 3, 4))) == want).all(), depth
        if depth <= 8:
            palette = RNG.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
            assert (D.decode_png(png(px, depth, 3, lace, palette)) == np.rint(palette[px[:, :, 0]] @ D.GREY)).all()
        if depth >= 8:
            for kind, bands in ((2, 3), (4, 2), (6, 4)):
                px = RNG.integers(0, top + 1, (h, w, bands))
                small = px >> 8 if depth == 16 else px
                want = small[:, :, 0] if bands == 2 else np.rint(small[:, :, :3] @ D.GREY)
                assert (D.decode_png(png(px, depth, kind, lace, filters=(4, 3))) == want).all()


def test_damaged_png():
    good = png(RNG.integers(0, 256, (20, 30, 1)), 8, 0, filters=(4,))
    for bad in (b"", good[:8], good[:40], good[:-30], good.replace(b"IDAT", b"IDAX"), good[:16] + struct.pack(">I", 1 << 31) + good[20:], png(np.full((3, 3, 1), 3), 2, 3, palette=np.zeros((2, 3), np.uint8)), good[:24] + b"\x03" + good[25:]):
        with pytest.raises(ValueError, match="PNG"):
            D.decode_png(bad)


def lzw(data):
    """TIFF's LZW by its definition."""
    table, out, bits, n, own = {bytes([i]): i for i in range(256)}, [], 9, 258, b""
    put = lambda code: out.append(format(code, f"0{bits}b"))
    put(256)
    for b in data:
        if own + bytes([b]) in table:
            own += bytes([b])
            continue
        put(table[own])
        table[own + bytes([b])] = n
        n += 1
        if n == 4095:
            put(256)
            table, n, bits = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            bits = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
        own = bytes([b])
    put(table[own])
    n += 1
    bits = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
    put(257)
    text = "".join(out)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def packbits(data):
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out


def tiff(pages, order="<"):
    """Pages (values (h, w, bands), depth, colours, compression, rows a strip, dpi, predictor) as one file."""
    out, links = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0", 4
    pack = {1: bytes, 32773: packbits, 5: lzw, 8: zlib.compress}
    for px, depth, colours, method, rows, dpi, predictor in pages:
        h, w, bands = px.shape
        own = px.copy()
        if predictor == 2:
            own[:, 1:] = (px[:, 1:] - px[:, :-1]) & ((1 << depth) - 1)
        lines = packed(own.reshape(h, -1), depth)
        if depth == 16 and order == "<":
            lines = lines.reshape(h, -1, 2)[:, :, ::-1].reshape(h, -1)
        strips = [pack[method](lines[y : y + rows].tobytes()) for y in range(0, h, rows)]
        starts = []
        for s in strips:
            starts.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        tags = {256: [w], 257: [h], 258: [depth] * bands, 259: [method], 262: [colours], 273: starts, 277: [bands], 278: [rows], 279: list(map(len, strips)), 317: [predictor]}
        if colours == 3:
            tags[320] = (np.arange(3 << depth) * 77 % 256 * 257).tolist()
        entries = []
        for tag, values in sorted(tags.items()):
            raw = struct.pack(order + f"{len(values)}{'H' if tag == 320 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, 3 if tag == 320 else 4, len(values)) + raw.ljust(4, b"\0"))
        if dpi:
            at = len(out)
            out += struct.pack(order + "II", dpi * 10, 10)
            entries.append(struct.pack(order + "HHII", 282, 5, 1, at))
            entries.append(struct.pack(order + "HHIHH", 296, 3, 1, 2, 0))
        entries.sort(key=lambda e: struct.unpack(order + "H", e[:2]))
        out[links : links + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("method", [1, 32773, 5, 8])
def test_tiff_of_every_kind(order, method):
    cases = [(1, 0, 1), (1, 1, 1), (4, 1, 1), (8, 0, 1), (8, 1, 1), (8, 1, 2), (8, 2, 3), (8, 2, 4), (16, 1, 1), (16, 2, 3), (8, 3, 1), (4, 3, 1)]
    for depth, colours, bands in cases:
        top = (1 << depth) - 1
        px = RNG.integers(0, top + 1, (23, 37, bands))
        px[5:9] = top
        for predictor in (1, 2) if depth >= 8 else (1,):
            data = tiff([(px, depth, colours, method, 10, 200, predictor)], order)
            read = lambda at, n, data=data: data[at : at + n]
            own, (page,) = D.tiff_pages(read)
            got = D.decode_tiff(page, read, own)
            small = px >> 8 if depth == 16 else px * (255 // top)
            if colours == 3:
                table = (np.arange(3 << depth) * 77 % 256).reshape(3, -1).T
                want = np.rint(table[px[:, :, 0]] @ D.GREY)
            else:
                want = np.rint(small[:, :, :3] @ D.GREY) if bands >= 3 else small[:, :, 0]
                want = 255 - want if colours == 0 else want
            assert page.dpi == 200 and (got == want).all(), (depth, colours, bands, predictor)


def test_long_lzw():
    data = RNG.integers(0, 7, 40_000, dtype=np.uint8).tobytes() + b"a" * 30_000
    assert D._lzw(lzw(data), len(data)) == data


def test_damaged_tiff():
    px = RNG.integers(0, 256, (9, 9, 1))
    good = tiff([(px, 8, 1, 1, 4, None, 1)])
    for bad in (good[:6], good[:-3], b"II*\0\0\0\0\0", good[:30]):
        with pytest.raises(ValueError, match="TIFF"):
            order, pages = D.tiff_pages(lambda at, n, bad=bad: bad[at : at + n])
            D.decode_tiff(pages[0], lambda at, n, bad=bad: bad[at : at + n], order)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    (root / "sub").mkdir()
    grey = RNG.integers(0, 256, (40, 30, 1))
    (root / "a.png").write_bytes(png(grey, 8, 0, dpi=300, filters=(4,)))
    (root / "bits.PNG").write_bytes(png(grey % 2, 1, 0, lace=1))
    (root / "sub/many.tif").write_bytes(tiff([(grey + i & 255, 8, 1, (1, 5, 8)[i % 3], 10, 300, 1) for i in range(7)]))
    (root / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nrubbish")
    (root / "none.tiff").write_bytes(b"")
    (root / "lie.png").write_bytes(b"GIF89a")
    (root / "doc.pdf").write_bytes(b"%PDF-1.4")
    (root / "notes.txt").write_text("no page")
    return root, grey


def jpeg(spark, path, h=16, w=24, level=90):
    """A grey JPEG by the JVM's own writer."""
    j = spark.sparkContext._jvm
    image = j.java.awt.image.BufferedImage(w, h, 10)
    for y in range(h):
        for x in range(w):
            image.getRaster().setSample(x, y, 0, level)
    assert j.javax.imageio.ImageIO.write(image, "jpg", j.java.io.File(str(path)))


def test_one_entry_for_all_formats(spark, folder):
    root, grey = folder
    jpeg(spark, root / "photo.jpg")
    rows = X.read_pages(spark, str(root), target_dpi=300).collect()
    got = {(r.path.rpartition("/")[2], r.page): r for r in rows}
    assert len(got) == len(rows) == 14
    assert bytes(got["a.png", 0].gray) == grey.astype(np.uint8).tobytes() and got["a.png", 0].dpi == pytest.approx(300, abs=0.1)
    for i in range(7):
        assert bytes(got["many.tif", i].gray) == (grey + i & 255).astype(np.uint8).tobytes()
    bits = np.frombuffer(bytes(got["bits.PNG", 0].gray), np.uint8)
    assert got["bits.PNG", 0].original_width == 30 and set(bits.tolist()) == {0, 255}
    assert abs(int(bytes(got["photo.jpg", 0].gray)[0]) - 90) <= 2
    errors = {k[0]: r.error for k, r in got.items() if r.error}
    assert set(errors) == {"bad.png", "none.tiff", "lie.png", "doc.pdf"} and errors["none.tiff"] == "empty file" and errors["doc.pdf"] == "unsupported: pdf"
    assert all(r.gray is None for r in rows if r.error)


def test_one_page_of_every_file(spark, folder):
    root, grey = folder
    got = {r.path.rpartition("/")[2]: r for r in X.read_pages(spark, str(root), page=3).collect()}
    assert bytes(got["many.tif"].gray) == (grey + 3 & 255).astype(np.uint8).tobytes()
    assert got["a.png"].error == "page 3: the file has 1 page" == got["photo.jpg"].error and all(r.page == 3 for r in got.values())


def test_partitions_follow_bytes(spark, folder):
    root, _ = folder
    X.register(spark)
    df = spark.read.format("pages").option("partitionBytes", 2500).load(str(root))
    own = df.withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in own:
        tasks.setdefault(r.path.rpartition("/")[2], set()).add(r.task)
    assert len(own) == 12 and len(tasks["many.tif"]) >= 3  # a large file is read by several tasks
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("pages").load(str(root / "nowhere")).count()


def test_written_files(spark, tmp_path):
    rows = [(f"d{i % 3}/{i}.png", bytes([i] * i)) for i in range(50)] + [("top.bin", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    for _ in range(2):  # a second run writes the same
        X.write_files(df, str(tmp_path / "out"))
        found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        assert json.loads(found.pop("_SUCCESS")) == {"files": 51, "bytes": sum(range(50))}
        assert found == {n: c or b"" for n, c in rows}
    with pytest.raises(Exception, match="not a name"):
        X.write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), str(tmp_path / "bad"))
    assert not (tmp_path / "x").exists() and not list((tmp_path / "bad").rglob("_staging*"))


def test_package(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    bodies = {f"sub/{i}.jpg" if i % 2 else f"{i}é.jpg": bytes([i]) * (i * 97 + 1) for i in range(40)} | {"long/" + "n" * 150 + ".jpg": b"x" * 2000}
    for name, body in bodies.items():
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    (tmp_path / "train.json").write_text("{}")
    pages = spark.createDataFrame([(n,) for n in [*bodies, "gone.jpg", "gone too.jpg", "0é.jpg"]], "name string")
    out = tmp_path / "out"
    got = X.package(pages, str(tmp_path / "in"), {"splits/train.json": str(tmp_path / "train.json")}, str(out), shards=3)
    assert got == {"pages": 41, "missing": 2, "required": 1}
    want = bodies | {"splits/train.json": b"{}"}
    shards = sorted(out.glob("*.tar"))
    assert len(shards) == 3
    names = [n for s in shards for n in subprocess.run(["tar", "-tf", s], capture_output=True, check=True, env={"LC_ALL": "C.UTF-8", "PATH": "/bin:/usr/bin"}).stdout.decode().splitlines()]
    assert len(names) == len(want)
    members = [json.loads(x) for p in out.glob("*.jsonl") for x in p.read_text().splitlines()]
    for m in members:
        data = (out / m["shard"]).read_bytes()
        assert data[m["offset"] : m["offset"] + m["size"]] == want.pop(m["name"])
    assert not want and not list(out.glob("_staging*"))
    with pytest.raises(FileNotFoundError):
        X.package(pages, str(tmp_path / "in"), {"splits/val.json": str(tmp_path / "val.json")}, str(out))
    assert len(sorted(out.glob("*.tar"))) == 3  # nothing was touched


def test_pages_as_png(spark):
    img = RNG.integers(0, 256, (17, 9), dtype=np.uint8)
    assert (D.decode_png(I.encode_png(img, 200)) == img).all()
