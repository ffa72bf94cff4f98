"""FITS images as a Spark data source: format("fits") reads and writes, in plain Python.

Options for reading: path (a file, a folder or a pattern that the driver and
all executors see as local; read_shared() reads from any file system that Spark
reads), hdu (a number; by default
the first with two axes or more), headers_only, max_size, planes (see Reading). Unreadable files give a row with
_error unless mode is failfast; nothing is dropped silently.
"""

from __future__ import annotations

import glob
import io
import os
import re
import signal
import struct
import subprocess
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80
SCHEMA = "path string, header map<string,string>, h int, w int, planes int, data array<double>, _error string"
#: Number types by BITPIX (fixed values).
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_header(raw: bytes) -> tuple[dict[str, str], int]:
    """The cards of one header and its length with padding."""
    out: dict[str, str] = {}
    for at in range(0, len(raw), CARD):
        card = raw[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return out, (at // BLOCK + 1) * BLOCK
        if card[8:10] != "= ":
            continue
        text = card[10:].strip()
        if text.startswith("'"):
            end = 1
            while end < len(text) and (text[end] != "'" or text[end : end + 2] == "''"):
                end += 2 if text[end : end + 2] == "''" else 1
            value = text[1:end].replace("''", "'").rstrip()
        else:
            value = text.split("/")[0].strip()
        out.setdefault(key, value)
    raise ValueError("a FITS header without an end")


def read_fits(raw: bytes, hdu: int | None = None) -> tuple[dict[str, str], np.ndarray]:
    """Header and image (float64) of the chosen unit, or the first with two axes or more."""
    at, k = 0, 0
    while at < len(raw):
        header, size = parse_header(raw[at:])
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", "0")))]
        bitpix = int(header.get("BITPIX", "8"))
        n = int(np.prod(axes)) if axes else 0
        at += size
        if (k == hdu) if hdu is not None else len(axes) >= 2:
            if not n:
                raise ValueError("the chosen unit has no data")
            if at + n * abs(bitpix) // 8 > len(raw):
                raise ValueError("a FITS file that ends before its data do")
            image = np.frombuffer(raw, KINDS[bitpix], n, at).reshape(axes[::-1]).astype(np.float64)
            return header, image * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
        at += -(-n * abs(bitpix) // 8 // BLOCK) * BLOCK
        k += 1
    raise ValueError("no image in the FITS file")


def card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{value!r:>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key.upper()[:8]:<8}= {text}".encode("ascii", "replace")[:CARD].ljust(CARD)


def write_fits(image: np.ndarray, header: dict | None = None, extensions: list[tuple[str, np.ndarray]] = ()) -> bytes:
    """An image (float32) and named image extensions as a FITS file."""

    def unit(first: list[bytes], data: np.ndarray, more: dict) -> bytes:
        shape = [card("NAXIS", data.ndim), *[card(f"NAXIS{i + 1}", n) for i, n in enumerate(data.shape[::-1])]]
        own = {"SIMPLE", "XTENSION", "BITPIX", "END", "NAXIS"}
        cards = [*first, card("BITPIX", -32), *shape, *[card(k, v) for k, v in more.items() if k.upper() not in own and not k.upper().startswith("NAXIS")], b"END".ljust(CARD)]
        head, body = b"".join(cards), data.astype(">f4").tobytes()
        return head.ljust(-(-len(head) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")

    out = unit([card("SIMPLE", True)], np.asarray(image), header or {})
    for name, data in extensions:
        out += unit([card("XTENSION", "IMAGE   ")], np.asarray(data), {"PCOUNT": 0, "GCOUNT": 1, "EXTNAME": name})
    return out


def read_header(f, hdu: int | None = None) -> dict[str, str]:
    """The header alone of the chosen unit of an open file, or of the first with two axes or more; no data are read."""
    at, k = 0, 0
    f.seek(0, os.SEEK_END)
    size = f.tell()
    while at < size:
        f.seek(at)
        raw = b""
        while True:
            block = f.read(BLOCK)
            raw += block
            if len(block) < BLOCK or any(block[i : i + 8].strip() == b"END" for i in range(0, BLOCK, CARD)):
                break
        header, length = parse_header(raw)
        axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", "0")))]
        if (k == hdu) if hdu is not None else len(axes) >= 2:
            return header
        n = int(np.prod(axes)) if axes else 0
        at += length + -(-n * abs(int(header.get("BITPIX", "8"))) // 8 // BLOCK) * BLOCK
        k += 1
    raise ValueError("no image in the FITS file")


@dataclass(frozen=True)
class Reading:
    """How files become rows."""

    hdu: int | None = None
    #: Only headers are read; data is null.
    headers_only: bool = False
    #: Larger images are averaged in whole blocks until they fit.
    max_size: int | None = None
    #: A colour sensor's frame (by its header's pattern) becomes four planes of half its size, in the order R, G0, G1, B.
    planes: bool = False
    failfast: bool = False

    def row(self, path: str, f) -> tuple:
        try:
            if self.headers_only:
                header = read_header(f, self.hdu)
                axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header["NAXIS"]))]
                return path, header, axes[1], axes[0], axes[2] if len(axes) > 2 else 1, None, None
            header, image = read_fits(f.read(), self.hdu)
            image = np.squeeze(image) if self.hdu is not None else image
            pattern = header.get("BAYERPAT", header.get("COLORTYP", "")).strip().upper()
            if self.planes and pattern in PATTERNS and image.ndim == 2:
                cells = dict(zip(PATTERNS[pattern], ((0, 0), (0, 1), (1, 0), (1, 1))))
                h, w = (n // 2 * 2 for n in image.shape)
                image = np.stack([image[r:h:2, c:w:2] for r, c in (cells[k] for k in ("R", "G0", "G1", "B"))])
            if self.max_size and max(image.shape[-2:]) > self.max_size:
                k = -(-max(image.shape[-2:]) // self.max_size)
                h, w = (n // k for n in image.shape[-2:])
                image = image[..., : h * k, : w * k].reshape(*image.shape[:-2], h, k, w, k).mean(axis=(-3, -1))
            planes = image.shape[0] if image.ndim == 3 else 1
            return path, header, int(image.shape[-2]), int(image.shape[-1]), planes, image.ravel(), None
        except (ValueError, KeyError, IndexError, struct.error) as e:
            if self.failfast:
                raise
            return path, None, None, None, None, None, str(e)

    def batch(self, path: str, f) -> pa.RecordBatch:
        """The row as an Arrow batch: pixels stay an array all the way."""
        path, header, h, w, planes, data, error = self.row(path, f)
        cells = [path, list(header.items()) if header is not None else None, h, w, planes, data, error]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, ARROW)], names=[c.split()[0] for c in SCHEMA.split(", ")])


ARROW = (pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
#: The channels of a pattern's two by two cell, row by row (fixed values).
PATTERNS = {"RGGB": ("R", "G0", "G1", "B"), "BGGR": ("B", "G0", "G1", "R"), "GRBG": ("G0", "R", "B", "G1"), "GBRG": ("G0", "B", "R", "G1")}


class FitsFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FitsReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        flag = lambda k: options.get(k, "false").lower() == "true"
        number = lambda k: int(options[k]) if k in options else None
        self.reading = Reading(number("hdu"), flag("headers_only"), number("max_size"), flag("planes"), options.get("mode", "").lower() == "failfast")

    def partitions(self):
        return [FitsFile(p) for p in list_fits(self.root)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield self.reading.batch(partition.path, f)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class FitsWriter(DataSourceArrowWriter):
    """Writes each row (name, h, w, data, and header and extensions where it has them) as one file of the folder path.

    data of several planes is a cube; extensions are further images by name.
    Tasks write files under names of their own, which the commit renames, so a
    job that fails leaves no file, and one that is repeated leaves each once.
    """

    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")

    def write(self, batches):
        os.makedirs(self.root, exist_ok=True)
        files = []
        for batch in batches:
            have = set(batch.schema.names)
            for k in range(batch.num_rows):
                cell = lambda c: batch.column(c)[k] if c in have else pa.scalar(None)  # noqa: E731, B023
                h, w = cell("h").as_py(), cell("w").as_py()
                image = cell("data").values.to_numpy(zero_copy_only=False).reshape(-1, h, w)
                more = [(n, np.asarray(v, dtype=np.float64).reshape(h, w)) for n, v in (cell("extensions").as_py() or [])]
                target = os.path.join(self.root, f"{cell('name').as_py()}.fits")
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(write_fits(image[0] if len(image) == 1 else image, dict(cell("header").as_py() or []), more))
                files.append(part)
        return Written(files)

    def commit(self, messages):
        for m in messages:
            for part in m.files if m else ():
                os.replace(part, part.rsplit(".", 2)[0])

    def abort(self, messages):
        for m in messages:
            for part in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)


class FitsSource(DataSource):
    @classmethod
    def name(cls):
        return "fits"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FitsReader(self.options)

    def writer(self, schema, overwrite):
        return FitsWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def list_fits(root: str) -> list[str]:
    """Files of a folder (or pattern) by extension in any case, sorted, each once."""
    if os.path.isfile(root):
        return [root]
    found = glob.glob(os.path.join(root, "**", "*"), recursive=True) if os.path.isdir(root) else glob.glob(root, recursive=True)
    return sorted({p for p in found if p.lower().endswith((".fits", ".fit", ".fts"))})


def read_shared(spark: SparkSession, path: str, hdu: int | None = None, **how) -> DataFrame:
    """The same rows through Spark's own file reader, for stores that only Spark reaches; how: as Reading has it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fits,fit,fts,FITS,FIT,FTS}").load(path).select("path", "content")
    reading = Reading(hdu, **how)

    def run(batches):
        for batch in batches:
            for p, c in zip(batch.column("path"), batch.column("content")):
                yield reading.batch(p.as_py(), io.BytesIO(c.as_buffer()))

    return files.mapInArrow(run, SCHEMA)


#: What headers and folders call the kinds of frames (fixed values).
TYPE_NAMES = {
    "bias": ("bias", "bias frame", "biases", "zero", "offset"),
    "dark": ("dark", "dark frame", "darks"),
    "flat": ("flat", "flat frame", "flats", "flat field"),
    "dark_flat": ("dark_flat", "dark flat", "darkflat", "dark flat frame", "dark_flats", "darkflats", "flat dark"),
    "light": ("light", "light frame", "lights", "object", "science"),
}


def frame_type(name):
    """A frame's kind from what a header or folder calls it; null if unknown."""
    n = F.lower(F.trim(name))
    out = None
    for kind, names in TYPE_NAMES.items():
        out = F.when(n.isin(*names), kind) if out is None else out.when(n.isin(*names), kind)
    return out


def discover(frames: DataFrame) -> DataFrame:
    """frames(path, header) with frame_type; frames of unknown kind go.

    A calibration frame's folder tells its kind, if any folder of the table
    does, else its IMAGETYP. Lights are known by their folder or IMAGETYP in
    either case, so a folder of lights hides no calibration frames.
    """
    folder = frame_type(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    typed = frames.withColumns({"__folder": folder, "__header": frame_type(F.element_at("header", "IMAGETYP"))})
    sorted_out = not typed.where(F.col("__folder") != "light").isEmpty()
    kind = F.coalesce("__folder", F.when(F.col("__header") == "light", F.col("__header")) if sorted_out else F.col("__header"))
    return typed.withColumn("frame_type", kind).drop("__folder", "__header").where("frame_type IS NOT NULL")


def header_values(frames: DataFrame, default_exposure: float | None = None) -> DataFrame:
    """frames with exposure_s, temperature_c, gain and bayer_pattern from the header's usual keys; without an exposure or a default, an error."""
    first = lambda *keys: F.coalesce(*[F.element_at("header", k) for k in keys])
    t = first("EXPTIME", "EXPOSURE").try_cast("double")
    t = F.coalesce(t, F.lit(default_exposure)) if default_exposure is not None else F.when(t.isNotNull(), t).otherwise(F.raise_error(F.lit("a header without an exposure")).cast("double"))
    bayer = F.upper(F.trim(first("BAYERPAT", "COLORTYP", "BAYOFFX")))
    return frames.withColumns({"exposure_s": t, "temperature_c": first("CCD-TEMP", "CCDTEMP", "TEMP").try_cast("double"), "gain": first("GAIN", "EGAIN").try_cast("double"), "bayer_pattern": F.when(bayer.isin("RGGB", "BGGR", "GRBG", "GBRG"), bayer)})


def require_lights(frames: DataFrame) -> DataFrame:
    if frames.isEmpty():
        raise FileNotFoundError("no light frames")
    return frames


@dataclass(frozen=True)
class PlateSolver:
    """An outside program that solves a file's plate and writes the WCS into its header, for solve_plates().

    It is given the file, the search radius (degrees), the reduction, the least
    number of stars and the header's place on the sky, has so many seconds, and
    is ended with all its processes after them. It has solved the plate if it
    says so; what counts is the header as it stands then.
    """

    program: str = "astap"
    radius: float = 10.0
    downsample: int = 2
    min_stars: int = 10
    seconds: float = 120.0

    def command(self, path: str, header: dict[str, str]) -> list[str]:
        out = [self.program, "-f", path, "-r", str(self.radius), "-z", str(self.downsample), "-s", str(self.min_stars), "-update"]
        ra, dec = (degrees(header.get(a) or header.get(b), hours) for a, b, hours in (("OBJCTRA", "RA", True), ("OBJCTDEC", "DEC", False)))
        if ra is not None:
            out += ["-ra", f"{ra / 15:.6f}"]  # hours
        if dec is not None:
            out += ["-spd", f"{dec + 90:.6f}"]  # from the south pole
        return out

    def __call__(self, path: str) -> dict[str, float] | None:
        path = path.removeprefix("file:")
        with open(path, "rb") as f:
            header = read_header(f)
        p = subprocess.Popen(self.command(path, header), stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, start_new_session=True)
        try:
            said, _ = p.communicate(timeout=self.seconds)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            raise TimeoutError(f"no solution within {self.seconds:g} s") from None
        if p.returncode or "solution found" not in said.lower():
            return None
        with open(path, "rb") as f:
            header = read_header(f)
        return {k: float(header[k]) for k in WCS_KEYS if k in header} or None


#: The header's names for what geometry.WCS calls crpix1 to cd22, in that order (fixed values).
WCS_KEYS = ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")


def degrees(text: str | None, hours: bool = False) -> float | None:
    """Degrees from a number or from 'DD MM SS' with blanks or colons; hours count 15 degrees each, a plain number is degrees."""
    parts = re.split(r"[:\s]+", (text or "").strip())
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return None
    if len(numbers) == 1:
        return numbers[0]
    size = sum(abs(n) / 60**k for k, n in enumerate(numbers[:3])) * (15 if hours else 1)
    return -size if parts[0].startswith("-") else size


def with_wcs(frames: DataFrame, source: str = "header") -> DataFrame:
    """frames with crpix1..cd22 from a map of keywords (a header, or the wcs of solve_plates); null where they are absent."""
    names = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")
    return frames.withColumns({n: F.element_at(source, k).try_cast("double") for n, k in zip(names, WCS_KEYS)})


def solve_plates(frames: DataFrame, solver) -> DataFrame:
    """frames(frame_id, path) with wcs (a map of keywords) and solve_status, by an injected solver(path) -> dict or None; a solver's error becomes the status."""

    def run(batches):
        for pdf in batches:
            wcs, status = [], []
            for p in pdf.path:
                try:
                    found = solver(p)
                    wcs.append({k: float(v) for k, v in found.items()} if found else None)
                    status.append("solved" if found else "failed")
                except Exception as e:  # one frame's failure is that frame's status
                    wcs.append(None), status.append(f"error: {e}"[:200])
            pdf["wcs"], pdf["solve_status"] = wcs, status
            yield pdf

    kinds = dict(frames.dtypes)
    return frames.select("frame_id", "path").mapInPandas(run, f"frame_id {kinds['frame_id']}, path string, wcs map<string,double>, solve_status string")
