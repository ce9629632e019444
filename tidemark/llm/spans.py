"""Long spans that stand word for word in more than one text, found with a log-structured index of window hashes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import join_same, measured_side, new_path, remove, stage

#: Characters that one pass of the hash functions holds at once; longer texts go through in overlapping parts.
CHUNK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_BASE_A, _BASE_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(symbols: np.ndarray, base: np.uint64, length: int) -> dict[int, tuple[np.ndarray, np.uint64]]:
    """Hashes of all stretches of 1, 2, 4 .. symbols up to `length`, each from two halves, with the base to that power."""
    out, n = {1: (symbols, base)}, 1
    with np.errstate(over="ignore"):
        while 2 * n <= length:
            h, p = out[n]
            out[2 * n] = (h[:-n] * p + h[n:], p * p)
            n *= 2
    return out


def rolling(symbols: np.ndarray, length: int, base: np.uint64 = _BASE_A) -> np.ndarray:
    """The hash of every stretch of `length` code points; equal stretches have equal hashes wherever they stand."""
    count = len(symbols) - length + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (symbols.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        table = _powers(mixed, base, length)
        out, at, rest = None, 0, length
        while rest:
            n = 1 << (rest.bit_length() - 1)
            h, p = table[n]
            piece = h[at : at + count]
            out = piece.copy() if out is None else out * p + piece
            at, rest = at + n, rest - n
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n, out = 1, keys
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - n : len(keys) - n + 1]) if n < width else out


def _parts(texts: list[str | None], least: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Texts of at least `least` characters joined to arrays of about CHUNK code points: [(text number, offset in the text, length)] and the codes. Parts of one long text overlap by least - 1."""
    here, codes, size = [], [], 0
    for number, text in enumerate(texts):
        if text is None or len(text) < least:
            continue
        at = 0
        while True:
            part = text[at : at + CHUNK] if len(text) > CHUNK else text
            here.append((number, at, len(part)))
            codes.append(_codes(part))
            size += len(part)
            if size >= CHUNK // 2:
                yield here, np.concatenate(codes)
                here, codes, size = [], [], 0
            if at + len(part) >= len(text):
                break
            at += CHUNK - least + 1
    if here:
        yield here, np.concatenate(codes)


def select_fingerprints(texts: list[str | None], gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the winnowed grams: of every stretch of `span` characters the gram with the least hash, of equal ones the last.

    The choice depends on the stretch alone, so two texts that share `span` characters have at least one chosen
    gram in common; about 2 of span - gram + 2 grams are chosen.
    """
    width = span - gram + 1
    numbers, places, hashes = [], [], []
    for here, codes in _parts(texts, span):
        grams = rolling(codes, gram)
        index = np.arange(len(grams), dtype=np.uint64)
        keys = _sliding_min((grams & ~_LOW) | (_LOW - index), width)
        starts = np.cumsum([0, *(n for _, _, n in here)])
        valid = np.ones(len(keys), dtype=bool)
        for end in starts[1:]:
            valid[max(end - span + 1, 0) : end] = False
        kept = keys[valid]
        chosen = (_LOW - (kept[np.r_[True, kept[1:] != kept[:-1]]] & _LOW)).astype(np.int64)
        which = np.searchsorted(starts, chosen, side="right") - 1
        numbers.append(np.array([h[0] for h in here])[which])
        places.append(chosen - starts[which] + np.array([h[1] for h in here])[which])
        hashes.append(grams[chosen])
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number, place, value = np.concatenate(numbers), np.concatenate(places), np.concatenate(hashes)
    fresh = np.r_[True, (number[1:] != number[:-1]) | (place[1:] != place[:-1])]  # parts of a long text overlap
    return number[fresh], place[fresh], value[fresh]


def window_hashes(texts: list[str], places: list[np.ndarray], gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, hash, second hash, fresh) of every stretch of `span` characters that holds one of the grams at `places`; fresh is the first time that a stretch stands in its text."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for here, codes in _parts(texts, span):
        first, second = rolling(codes, span, _BASE_A), rolling(codes, span, _BASE_B)
        at = 0
        for number, offset, length in here:
            marks = np.zeros(length - span + 2, dtype=np.int64)
            low = np.clip(places[number] - (span - gram) - offset, 0, length - span + 1)
            high = np.clip(places[number] + 1 - offset, 0, length - span + 1)
            np.add.at(marks, low, 1)
            np.add.at(marks, high, -1)
            starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
            for column, values in zip(out, (np.full(len(starts), number), starts + offset, first[at + starts], second[at + starts])):
                column.append(values)
            at += length
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    number, start, first, second = (np.concatenate(c) for c in out)
    single = np.r_[True, (number[1:] != number[:-1]) | (start[1:] != start[:-1])]  # parts of a long text overlap
    number, start, first, second = number[single], start[single], first[single], second[single]
    order = np.lexsort((start, second, first, number))
    columns = [c[order] for c in (number, first, second)]
    fresh = np.ones(len(order), dtype=bool)
    fresh[order[1:]] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return number, start, first, second, fresh


def _slices(batches: Iterator[pa.RecordBatch], characters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, so that a worker's memory doesn't depend on the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + characters)))
            yield batch.slice(low, high - low)
            low = high


def fingerprints(docs: DataFrame, gram: int, span: int, carry: Sequence[str] = ()) -> DataFrame:
    """(h, doc, place, *carry) of the chosen grams of (doc, text, *carry); NULL texts and those under `span` characters have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            number, place, value = select_fingerprints(batch.column("text").to_pylist(), gram, span)
            kept = [batch.column(c).take(pa.array(number)) for c in ("doc", *carry)]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), kept[0], pa.array(place.astype(np.int32)), *kept[1:]], names=["h", "doc", "place", *carry])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    shape = ", ".join(["h bigint", f"doc {kind('doc')}", "place int", *(f"{c} {kind(c)}" for c in carry)])
    return docs.select("doc", "text", *carry).filter(F.length("text") >= span).mapInArrow(run, shape)


@dataclass
class Run:
    """One immutable sorted run, (h, low, high) with the least and largest document of each hash, bucketed by h and sorted by it, and the postings behind it."""

    level: int
    heads: str
    postings: list[str]
    table: str = ""


class _Folder:
    """Files of an index below one folder of the file system that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def fresh(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def has(self, path: str) -> bool:
        return self._files.exists(self._paths(path))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._files.listStatus(self._paths(self.path))] if self.has(self.path) else []

    def write(self, name: str, text: str) -> None:
        """A whole file or none: written aside and renamed."""
        aside, target = self._paths(f"{self.path}/.{name}"), self._paths(f"{self.path}/{name}")
        out = self._files.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._files.rename(aside, target):
            raise OSError(f"{target} could not be written")

    def read(self, name: str) -> str:
        source = self._files.open(self._paths(f"{self.path}/{name}"))
        text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        source.close()
        return text


@dataclass
class SpanIndex:
    """A log-structured index of window hashes for finding shared spans as batches arrive.

    A batch is fingerprinted once and its postings are written as they come. Their heads, one row (h, low, high) per
    hash, reduced before the shuffle, are written as a sorted run, in as many buckets as all runs have, and
    merge-joined bucket by bucket, without a shuffle, with those of every older run; a hash that stands in two
    documents is noted. `fanout` runs of a level are compacted into one of the next, so a head is rewritten only
    once per level and a posting never. `shared` verifies the noted places on the texts. A hash that stands in a
    third of all documents is one head of a run and one row in the joins; its postings are spread over all files.

    With `folder`, a path that all executors reach, the index lasts: a manifest names the runs after every batch, and
    a later session that opens the folder goes on from there; a batch that was cut off leaves the manifest as it was.
    Without, it lives below the shared folder and is deleted by close() or at the end of the process.
    """

    spark: SparkSession
    span: int = 200
    gram: int = 96
    buckets: int = 0
    fanout: int = 4
    folder: str | None = None
    runs: list[Run] = field(default_factory=list)
    noted: list[str] = field(default_factory=list)
    doc_type: str = ""

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.span:
            raise ValueError("gram must be from 1 to span")
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._lasts = self.folder is not None
        self._at = _Folder(self.spark, self.folder or new_path(self.spark, "span_index"))
        if known := sorted(n for n in self._at.names() if n.startswith("manifest-")):
            self._open(json.loads(self._at.read(known[-1])))

    def _open(self, manifest: dict) -> None:
        if (manifest["span"], manifest["gram"]) != (self.span, self.gram):
            raise ValueError(f"the index holds grams of {manifest['gram']} for spans of {manifest['span']} characters")
        self.buckets, self.doc_type, self.noted = manifest["buckets"], manifest["doc_type"], manifest["noted"]
        self.runs = [Run(**r) for r in manifest["runs"]]
        for run in self.runs:
            run.table = f"span_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {run.table} (h BIGINT, low {self.doc_type}, high {self.doc_type}) USING PARQUET CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{run.heads}'")

    def _save(self) -> None:
        manifest = {"span": self.span, "gram": self.gram, "buckets": self.buckets, "doc_type": self.doc_type, "noted": self.noted, "runs": [asdict(r) | {"table": ""} for r in self.runs]}
        older = [n for n in self._at.names() if n.startswith("manifest-")]
        number = max((int(n.split("-")[1].split(".")[0]) for n in older), default=0) + 1
        self._at.write(f"manifest-{number:08d}.json", json.dumps(manifest))
        for name in older:
            remove(self.spark, f"{self._at.path}/{name}")

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")

    def close(self) -> None:
        """Drop the tables of this session's catalog; files go too unless the index has a folder of its own."""
        for run in self.runs:
            self._drop(run)
        self.runs = []
        if not self._lasts:
            remove(self.spark, self._at.path)

    def _write(self, heads: DataFrame, level: int, postings: list[str]) -> Run:
        """The run of heads already grouped by hash; where their partitions are as many as the buckets, they are the buckets."""
        run = Run(level, self._at.fresh("run"), postings, f"span_run_{uuid.uuid4().hex}")
        placed = heads if int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets else heads.repartition(self.buckets, "h")
        placed.write.bucketBy(self.buckets, "h").sortBy("h").option("path", run.heads).saveAsTable(run.table)
        return run

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(f"h bigint, doc {self.doc_type}, place int").parquet(*paths)

    def add_batch(self, docs: DataFrame) -> None:
        """Take in (doc, text); doc is unique over all batches."""
        self.doc_type = docs.schema["doc"].dataType.simpleString()
        path = self._at.fresh("postings")
        fingerprints(docs, self.gram, self.span).write.parquet(path)
        self._take_in(path)

    def add_batches(self, docs: DataFrame, batch: str, count: int) -> None:
        """Take in (doc, text, `batch`), batch being from 0 to count - 1, one batch after the other; the texts are read once for all of them."""
        self.doc_type = docs.schema["doc"].dataType.simpleString()
        path = self._at.fresh("postings")
        fingerprints(docs, self.gram, self.span, [batch]).write.partitionBy(batch).parquet(path)
        for i in range(count):
            if self._at.has(part := f"{path}/{batch}={i}"):
                self._take_in(part)

    def _take_in(self, path: str) -> None:
        heads = self._read([path]).groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        new = self._write(heads, 0, [path])
        joined = self.spark.table(new.table).withColumn("hit", F.col("low") != F.col("high"))
        for run in self.runs:
            old = self.spark.table(run.table).select("h", F.lit(True).alias("old"))
            joined = joined.join(old.hint("merge"), "h", "left").withColumn("hit", F.col("hit") | F.coalesce("old", F.lit(False))).drop("old")
        noted = self._at.fresh("noted")
        joined.filter("hit").select("h").write.parquet(noted)
        self.noted.append(noted)
        self.runs.append(new)
        gone = self._compact()
        self._save()
        for run in gone:
            self._drop(run)
            remove(self.spark, run.heads)

    def _compact(self) -> list[Run]:
        """Runs of a level that is full made one of the next; gives the ones replaced, whose files go once the manifest is written."""
        gone, level = [], 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            merged = self.spark.table(full[0].table)
            for run in full[1:]:
                merged = merged.unionByName(self.spark.table(run.table))
            heads = merged.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            new = self._write(heads, level + 1, [p for r in full for p in r.postings])
            self.runs = [r for r in self.runs if r.level != level] + [new]
            gone += full
            level += 1
        return gone

    def _postings(self) -> DataFrame:
        """(doc, places) of the noted hashes, by document."""
        hashes = measured_side(self.spark.read.schema("h bigint").parquet(*self.noted).distinct(), "hashes")
        found = self._read([p for r in self.runs for p in r.postings]).join(hashes, "h", "left_semi")
        return found.groupBy("doc").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def windows(self, texts: DataFrame) -> DataFrame:
        """(a, b, doc, start, fresh): the two hashes of every stretch of `span` characters around a noted place."""
        gram, span = self.gram, self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                places = [np.array(p, dtype=np.int64) for p in batch.column("places").to_pylist()]
                number, start, first, second, fresh = window_hashes(batch.column("text").to_pylist(), places, gram, span)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), batch.column("doc").take(pa.array(number)), pa.array(start.astype(np.int32)), pa.array(fresh)], names=["a", "b", "doc", "start", "fresh"])

        marked = texts.join(measured_side(self._postings(), "places"), "doc")
        return marked.select("doc", "text", "places").mapInArrow(run, f"a bigint, b bigint, doc {texts.schema['doc'].dataType.simpleString()}, start int, fresh boolean")

    def shared(self, texts: DataFrame) -> Shared:
        """What all batches so far share; `texts` has (doc, text) of all their documents.

        Stretches are grouped by 128 bits of hash. The first of a group stands for it, and the others are compared
        with it in runs of consecutive stretches, by the SHA-256 of the run's characters on both sides; a run that
        differs is left out. So the work follows the length of shared text, never the number of pairs, and texts
        are read twice: for the windows and for the digests of each run once, however many documents share it.
        """
        if not self.runs:
            doc = texts.schema["doc"].dataType.simpleString()
            return Shared(self.spark.createDataFrame([], f"a bigint, b bigint, doc {doc}, start int, n_docs bigint, docs bigint, docs_2 bigint, other {doc}"), self.span)
        found = stage(self.windows(texts), "windows")
        members_of = (F.bit_xor(F.xxhash64("doc")).alias("docs"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("docs_2"))
        groups = found.filter("fresh").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), *members_of, F.min("doc").alias("other"), F.min_by("start", "doc").alias("other_start")).filter("n_docs > 1")
        members = stage(found.drop("fresh").join(groups, ["a", "b"]), "members")
        followed = members.filter((F.col("doc") != F.col("other")) | (F.col("start") != F.col("other_start"))).select("doc", "start", "other", (F.col("other_start") - F.col("start")).alias("shift"))
        line = Window.partitionBy("doc", "other", "shift").orderBy("start")
        islands = followed.withColumn("island", F.col("start") - F.row_number().over(line)).groupBy("doc", "other", "shift", "island").agg(F.min("start").alias("low"), (F.max("start") - F.min("start") + self.span).alias("length"))
        islands = stage(islands.drop("island"), "islands")
        mine = islands.select("doc", F.col("low").alias("at"), "length")
        theirs = islands.select(F.col("other").alias("doc"), (F.col("low") + F.col("shift")).alias("at"), "length")
        wanted = measured_side(mine.unionByName(theirs).distinct(), "wanted")
        digest = F.unhex(F.sha2(F.substring("text", F.col("at") + 1, F.col("length")), 256))
        digests = stage(texts.join(wanted, "doc").select("doc", "at", "length", digest.alias("digest")), "digests")
        own = digests.withColumnsRenamed({"at": "low", "digest": "own"})
        other = digests.select(F.col("doc").alias("other"), F.col("at").alias("there"), "length", F.col("digest").alias("first"))
        compared = islands.join(own, ["doc", "low", "length"]).withColumn("there", F.col("low") + F.col("shift")).join(other, ["other", "there", "length"])
        wrong = stage(compared.filter(F.col("own") != F.col("first")).select("doc", "other", "shift", "low", (F.col("low") + F.col("length")).alias("high")), "wrong")
        if not wrong.isEmpty():
            hit = (members["doc"] == wrong["doc"]) & (members["other"] == wrong["other"]) & (members["other_start"] - members["start"] == wrong["shift"]) & members["start"].between(wrong["low"], wrong["high"] - self.span)
            members = members.join(wrong, hit, "left_anti")
        return Shared(members.drop("other_start"), self.span)


@dataclass
class Shared:
    """The stretches that stand in more than one document, and what follows from them."""

    members: DataFrame
    span: int

    def spans(self) -> DataFrame:
        """(doc, start, end, n_docs): the longest unions of shared stretches of each document, and in how many documents the most shared part stands."""
        line = Window.partitionBy("doc").orderBy("start")
        places = self.members.groupBy("doc", "start").agg(F.max("n_docs").alias("n_docs"))
        gap = F.when(F.col("start") > F.lag("start").over(line) + self.span, 1).otherwise(0)
        islands = places.withColumn("gap", gap).withColumn("island", F.sum("gap").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy("doc", "island").agg(F.min("start").alias("start"), (F.max("start") + self.span).alias("end"), F.max("n_docs").alias("n_docs")).drop("island")

    def coverage(self, texts: DataFrame) -> DataFrame:
        """(doc, n_chars, n_spans, shared_chars, shared_share) of every document; a NULL or empty text has share NULL."""
        sums = self.spans().groupBy("doc").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
        sized = texts.select("doc", F.length("text").alias("n_chars"))
        joined = join_same(sized, measured_side(sums, "sums"), ["doc"], "left")
        return joined.select("doc", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.try_divide(F.coalesce("shared_chars", F.lit(0)).cast("double"), F.col("n_chars").cast("double")).alias("shared_share"))

    def pairs(self, chunk: int = 1_000) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: the documents that share a stretch.

        Stretches that stand in the same set of documents are one case, known by the set's size, least member and
        a fingerprint of 128 bits. A set of n documents is cut into parts of about `chunk`, and each part meets the whole set in a task of its own; the
        work is what comes out, and no task holds a whole large set's pairs.
        """
        one = self.members.groupBy("docs", "docs_2", "n_docs", "other").agg(F.min(F.struct("a", "b")).alias("w"))
        sets = one.select(F.col("w.a").alias("a"), F.col("w.b").alias("b"))
        inside = stage(join_same(self.members, measured_side(sets, "firsts"), ["a", "b"]).select("a", "b", "doc", "n_docs").distinct(), "sets")
        parts = F.ceil(F.col("n_docs") / chunk).cast("int")
        left = inside.select("a", "b", F.col("doc").alias("doc_a"), F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"))
        right = inside.select("a", "b", F.col("doc").alias("doc_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return left.join(right, ["a", "b", "part"]).filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()
