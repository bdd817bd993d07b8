"""A session's calls: open, give it a table bank, look at headers, decode, ask for the first error, close."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import lut
from tilewright.operators.gradient import checkpointed
from tilewright.plans import images
from tilewright.plans.verify import checked_chunks, code_of
from tilewright.sources.container import MAGIC, ContainerError, chunks_of, read_containers, write_containers
from tilewright.sources.tables import expanded, points_of, read_tables, write_factors


class Opened:
    """A folder whose headers have been looked at: what its files were then."""

    def __init__(self, path: str, files: tuple):
        self.path, self.files = path, files


class TileEngine:
    """Containers of one folder layout, read and written through a Spark session.

    Files and chunks are checked where they are read; the first error stays in last_error until it is asked for. Plans run when their rows are
    asked for: action() keeps the error of a plan that fails then. slots: folders that may be open at a time."""

    def __init__(self, spark: SparkSession, magic: bytes = MAGIC, slots: int = 16):
        if spark is None:
            raise ContainerError("INIT_FAIL", "no session")
        if slots < 1:
            raise ContainerError("INVALID_CONTEXT_COUNT", "a session has a slot at least")
        if len(magic) != 4:
            raise ContainerError("INVALID_HEADER", "a magic has four bytes")
        self.spark, self.magic, self.bank, self.factors, self._error = spark, magic, None, None, None
        self.slots, self._open, self._released, self._seen = slots, set(), False, None

    def __enter__(self) -> TileEngine:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def assign_bank(self, bank: DataFrame) -> DataFrame:
        """Take (lut_id, idx, x, y, z), at most 64 tables of 64 points of 0..63; returns the factors of all depths."""
        bad = bank.where("idx not between 0 and 63 or x not between 0 and 63 or y not between 0 and 63 or z not between 0 and 63 or lut_id not between 0 and 63")
        if not bad.isEmpty():
            raise self._keep(ContainerError("INVALID_LUT", "tables, entries and coordinates go from 0 to 63"))
        self.bank, self.factors = bank, lut.factors(bank)
        return self.factors

    def assign_file(self, path: str) -> DataFrame:
        """Take the tables of a file, for encoding and decoding; returns each under its 48 modes, as decoders index them."""

        def run() -> DataFrame:
            self.factors = read_tables(self.spark, path)
            self.bank = points_of(self.factors)
            return expanded(self.factors)

        return self._run(run)

    def save_bank(self, path: str) -> None:
        """Write the tables taken last as a file."""
        if self.factors is None:
            raise self._keep(ContainerError("INVALID_LUT", "no tables are assigned"))
        self._run(lambda: write_factors(self.factors, path))

    def headers(self, path: str) -> DataFrame:
        """(path, width, height, alpha) of each file, without payloads."""
        return self._run(lambda: read_containers(self.spark, path, self.magic, payloads=False).select("path", "width", "height", "alpha").distinct())

    def encode(self, pixels: DataFrame, width: int, height: int, path: str, tables: bool = False, eight=None) -> None:
        """Write images (image_id, y, x, r, g, b and perhaps a) as a file each. tables: the tables taken last serve what gradients leave. eight: a
        column that is true for images whose alpha is kept in eight bits."""
        if width % 8 or height % 8 or not 0 < width < 1 << 16 or not 0 < height < 1 << 16:
            raise self._keep(ContainerError("INVALID_SIZE", "width and height are multiples of 8 of 16 bits"))
        if tables and self.bank is None:
            raise self._keep(ContainerError("INVALID_LUT", "no tables are assigned"))
        self._run(lambda: write_containers(images.encode(pixels, width, height, self.bank if tables else None, eight), path, self.magic))

    def open(self, path: str) -> Opened:
        """Look at the headers of a folder's files and take a slot until close(); decode(opened) then takes these files and no others."""

        def run() -> Opened:
            if len(self._open) >= self.slots:
                raise ContainerError("NO_EMPTYDECODE_SLOT", f"{self.slots} folders are open")
            if not self._files(path):
                raise ContainerError("INVALID_STREAM", "the folder has no files")
            self.headers(path).count()
            found = Opened(path, self._files(path))
            self._open.add(found)
            return found

        return self._run(run)

    def close(self, opened: Opened) -> None:
        self._open.discard(opened)

    def _files(self, path: str) -> tuple:
        """How many files there are, their bytes, and a sum over their paths, lengths and times."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(path).select("path", "length", "modificationTime")
        got = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        return tuple(got) if got[0] else ()

    def decode(self, source: str | Opened, permissive: bool = False) -> DataFrame:
        """(name, y, x, r, g, b, a) of all files of a folder, which have one size; a is null without alpha.

        permissive: broken files are left out, and the code of the first by path is kept; else a broken file fails the plan."""

        def run() -> DataFrame:
            path = source
            if isinstance(source, Opened):
                if source not in self._open:
                    raise ContainerError("DECIMG_INVALIDCTX", "not open here")
                if self._files(source.path) != source.files:
                    raise ContainerError("DECIMG_DIFFSTREAM", "files have changed since they were opened")
                path = source.path
            if permissive:
                seen = Observation()
                chunks = checkpointed(self._checked(path, seen)).where("code is null").drop("code")
                if code := seen.get["code"]:
                    self._error = self._error or code
            else:
                chunks = read_containers(self.spark, path, self.magic)
            chunks = chunks.withColumn("name", F.regexp_extract("path", r"([^/]+)\.tile$", 1))
            sizes = chunks.select("width", "height").distinct().limit(2).collect()
            if permissive and not sizes:
                return self.spark.createDataFrame([], "name string, y int, x int, r int, g int, b int, a int")
            if len(sizes) != 1:
                raise ContainerError("INVALID_SIZE", "the files of a folder have one size")
            return images.decode(chunks, sizes[0].width, sizes[0].height, self.factors)

        return self._run(run)

    def _checked(self, path: str, seen: Observation | None = None) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(path)
        return checked_chunks(files, self.magic, self.factors is not None, seen)

    def check(self, path: str) -> DataFrame:
        """(path, code) of each file of a folder, code null where nothing is wrong: nothing fails, whatever the files hold."""
        return self._run(lambda: self._checked(path).groupBy("path").agg(F.max("code").alias("code")))

    def decode_into(self, source: str | Opened, write) -> None:
        """Decode and hand the rows to a caller's function, which writes them where it likes."""
        if not callable(write):
            raise self._keep(ContainerError("DECIMG_BUFFERNOTSET", "nowhere to put the pixels"))
        self.action(lambda: write(self.decode(source)))

    def action(self, call):
        """Run what makes rows of plans (a count, a write); its error is kept, also where a task raised it."""
        return self._run(call)

    def transform_output(self, pixels: DataFrame, builder) -> DataFrame:
        """Pixels through a caller's function of a DataFrame."""
        return pixels.transform(builder)

    def last_error(self) -> str | None:
        """The code of the first error since the last call."""
        code, self._error = self._error, None
        return code

    def release(self) -> None:
        """Give up tables and open folders. To release twice is an error that is kept and not raised."""
        if self._released:
            self._keep(ContainerError("RELEASE_EMPTY_LIBRARY", "released before"))
        self.bank = self.factors = None
        self._open, self._released = set(), True

    def _keep(self, error: Exception) -> Exception:
        self._error = self._error or code_of(error)
        return error

    def _run(self, call):
        if self._released:
            raise self._keep(ContainerError("INVALID_LIBRARYCTX", "the session is released"))
        try:
            return call()
        except Exception as error:
            raise self._keep(error) from None


__all__ = ["TileEngine", "Opened", "ContainerError", "chunks_of"]
