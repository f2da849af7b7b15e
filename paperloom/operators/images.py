"""Page images: decoding, cropping, and clean-up in numpy over Arrow batches.

Definitions are our own where a library's are not public constants of the task:
crops take whole pixels (floor of left and top, ceiling of right and bottom); gray is
0.299 R + 0.587 G + 0.114 B; resizing is bicubic (a = -0.75) on pixel centres with
repeated edges; the local threshold compares with a Gaussian mean (sigma =
0.3 * ((block - 1) / 2 - 1) + 0.8, repeated edges) less the strength.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S


def encode_png(a: np.ndarray) -> bytes:
    """PNG bytes of an H×W or H×W×3 array of uint8."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """H×W or H×W×3 array of a PNG of 8 bits a sample, without interlacing; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("cannot identify image file")
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("picture format not recognised")
    w, h, planes = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    except zlib.error as e:
        raise ValueError("image file is truncated") from e
    if len(raw) < h * (1 + w * planes):
        raise ValueError("image file is truncated")
    raw = raw[: h * (1 + w * planes)].reshape(h, 1 + w * planes)
    out = np.zeros((h, w * planes), np.uint8)
    above = np.zeros(w * planes, np.int64)
    for y in range(h):
        kind, row = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            row = (row + above) & 255
        elif kind == 1:
            row = np.cumsum(row.reshape(w, planes), axis=0).reshape(-1) & 255
        elif kind in (3, 4):
            for x in range(w * planes):
                a, b, c = (row[x - planes], above[x], above[x - planes]) if x >= planes else (0, above[x], 0)
                if kind == 3:
                    row[x] = (row[x] + (a + b) // 2) & 255
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    row[x] = (row[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        out[y], above = row, row
    px = out.reshape(h, w, planes)
    if head[3] == 3:
        if palette is None:
            raise ValueError("picture format not recognised")
        return palette[np.minimum(px[..., 0], len(palette) - 1)]
    return px[..., 0] if planes < 3 else px[..., :3]


def decode(data: bytes | None) -> np.ndarray:
    """Upright pixels (gray or RGB) of a page's bytes; ``ValueError`` if they are no picture.

    PNG is read here; other formats need the optional imaging library on the workers.
    """
    if not data:
        raise ValueError("no file content")
    data = bytes(data)
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ValueError("cannot identify image file") from e
    try:
        a = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except (OSError, SyntaxError) as e:
        raise ValueError(str(e)) from e
    return upright(a, exif_orientation(data))


def cut_pages(files: DataFrame) -> DataFrame:
    """One row per region or whole file with its ``png``, or one row per file with an ``error``.

    Takes one row per file: its content and its regions with boxes in the unit square, so
    that a page is decoded once and turned upright before its own size scales the boxes. A
    whole file goes out as it is.
    """
    keep = ["job_id", "file_index", "filename", "model", "prompt", "options"]
    schema = "job_id string, file_index int, filename string, model string, prompt string, options map<string,string>, poly_idx int, region_order int, png binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                own = [r[k] for k in keep]
                own[-1] = dict(own[-1] or {})
                try:
                    if r["content"] is None:
                        raise ValueError("no file content")
                    rows, page = [], None
                    for p in r["regions"]:
                        if p["poly_idx"] is None or p["box"] is None:
                            rows.append((*own, None, None, bytes(r["content"]), None))
                            continue
                        page = decode(r["content"]) if page is None else page
                        h, w = page.shape[:2]
                        b = p["box"]
                        rows.append((*own, p["poly_idx"], p["region_order"], encode_png(crop(page, b["left"] * w, b["top"] * h, b["right"] * w, b["bottom"] * h)), None))
                    out += rows
                except Exception as e:  # noqa: BLE001 - a bad file is data, not a failed task
                    out.append((*own, None, None, None, str(e)))
            x = pd.DataFrame(out, columns=[*keep, "poly_idx", "region_order", "png", "error"])
            yield x.astype({"poly_idx": "Int32", "region_order": "Int32"})

    return files.select(*keep, "regions", "content").mapInPandas(run, schema)


def exif_orientation(data: bytes) -> int:
    """Orientation 1..8 in a JPEG's EXIF block; 1 if there is none."""
    at = data.find(b"Exif\0\0", 0, 70_000)
    if data[:2] != b"\xff\xd8" or at < 0:
        return 1
    t = data[at + 6 :]
    e = "<" if t[:2] == b"II" else ">"
    try:
        ifd = struct.unpack(e + "I", t[4:8])[0]
        for k in range(struct.unpack(e + "H", t[ifd : ifd + 2])[0]):
            tag, _, _, v = struct.unpack(e + "HHIH", t[ifd + 2 + 12 * k : ifd + 12 + 12 * k])
            if tag == 0x0112:
                return v if 1 <= v <= 8 else 1
    except struct.error:
        return 1
    return 1


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as an EXIF orientation says."""
    turned = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: np.swapaxes(x, 0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: np.rot90(np.swapaxes(x, 0, 1), 2), 8: lambda x: np.rot90(x, 1)}
    return turned[orientation](a) if orientation in turned else a


def crop(a: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    return a[int(np.floor(top)) : int(np.ceil(bottom)), int(np.floor(left)) : int(np.ceil(right))]


def gray(a: np.ndarray) -> np.ndarray:
    """Gray of a B, G, R array as Spark's image source gives it."""
    if a.ndim == 2 or a.shape[2] == 1:
        return a.reshape(a.shape[:2])
    return np.clip(np.rint(0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]), 0, 255).astype(np.uint8)


def _cubic(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    x = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    i = np.floor(x).astype(int)
    at = i[:, None] + np.arange(-1, 3)[None, :]
    d, k = np.abs(x[:, None] - at), -0.75
    w = np.where(d <= 1, (k + 2) * d**3 - (k + 3) * d**2 + 1, np.where(d < 2, k * d**3 - 5 * k * d**2 + 8 * k * d - 4 * k, 0))
    return np.clip(at, 0, n_in - 1), w


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic resize of a gray array."""
    yi, yw = _cubic(a.shape[0], height)
    xi, xw = _cubic(a.shape[1], width)
    rows = np.einsum("okw,ok->ow", a.astype(float)[yi], yw)
    out = np.einsum("hok,ok->ho", rows[:, xi], xw)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def local_threshold(a: np.ndarray, block: int, strength: int) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood mean less ``strength``."""
    r = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()
    p = np.pad(a.astype(float), r, mode="edge")
    rows = sum(g[k] * p[k : k + a.shape[0]] for k in range(block))
    mean = sum(g[k] * rows[:, k : k + a.shape[1]] for k in range(block))
    return np.where(a > np.rint(mean) - strength, 255, 0).astype(np.uint8)


def plan_sizes(images: DataFrame, dpi: int) -> DataFrame:
    """Adds (target, out_height, out_width, block) for (height, width) rows."""
    target = S.target_pixels(F.lit(dpi))
    scale = target / F.least("height", "width")
    use = (scale != 1.0) & (scale > 0.1)
    size = lambda c: F.when(use, F.floor(F.col(c) * scale)).otherwise(F.col(c)).cast("int")
    return images.withColumns({"target": target, "out_height": size("height"), "out_width": size("width"), "block": S.block_size(target)})


def preprocess(images: DataFrame, dpi: int, strength: int = K.DEFAULT_STRENGTH) -> DataFrame:
    """(path, png, error) of ``image``-source rows (path, height, width, nChannels, data).

    An image that can't be worked on gives an error row instead of failing the task.
    """
    planned = plan_sizes(images, dpi).select("path", "height", "width", "nChannels", "data", "out_height", "out_width", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    a = gray(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., :3])
                    if (r.out_height, r.out_width) != a.shape:
                        a = resize(a, r.out_height, r.out_width)
                    out.append((r.path, encode_png(local_threshold(a, r.block, strength)), None))
                except (ValueError, TypeError) as e:
                    out.append((r.path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "png", "error"])

    return planned.mapInPandas(run, "path string, png binary, error string")


def crops(regions: DataFrame) -> DataFrame:
    """Adds ``png``, the crop of each (box, height, width, nChannels, data) row; keyed by box, never reused."""
    schema = "job_id string, file_index int, poly_idx int, png binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., :3]
                c = crop(a, r.left, r.top, r.right, r.bottom)
                out.append((r.job_id, r.file_index, r.poly_idx, encode_png(c[..., ::-1] if c.shape[2] == 3 else c[..., 0])))
            yield pd.DataFrame(out, columns=["job_id", "file_index", "poly_idx", "png"])

    b = regions.select("job_id", "file_index", "poly_idx", "box.left", "box.top", "box.right", "box.bottom", "height", "width", "nChannels", "data")
    return b.mapInPandas(run, schema)


def threshold_vectors(embeddings: DataFrame, side: int = 8, block: int = 11, strength: int = 2) -> DataFrame:
    """(vec_id, ink): vectors read as small gray images, share of dark pixels after the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ink = []
            for v in pdf["embedding"]:
                a = np.asarray(v, float)[: side * side].reshape(side, side)
                a = ((a - a.min()) / (np.ptp(a) + 1e-9) * 255).astype(np.uint8)
                ink.append(float((local_threshold(a, block, strength) == 0).mean()))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "ink": ink})

    return embeddings.select("vec_id", "embedding").where(F.size("embedding") >= side * side).mapInPandas(run, "vec_id long, ink double")
