"""Packing token sequences: minimum bin slack on the table of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import ranked, reaching, table, text_batches, written

END_ID = 1
CACHED_WORDS = 400_000
TOGETHER = 50
WORD_END = "</w>"


# white space 0, letters 1, digits 2, all else 3
_KIND = np.full(256, 3, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
_KIND[list(b"0123456789")] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A"):ord("Z") + 1] += 32


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of plain lower-case text, which ends in a line break, start and end.

    A unit is a run of letters, a digit, a contraction ('s 't 're 've 'm 'll 'd where a run of
    other characters could start) or a run of other characters.
    """
    kind = _KIND[data]
    begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 2)
    at = np.flatnonzero((data[:-2] == ord("'")) & begins[:-2]) if len(data) > 2 else np.zeros(0, np.int64)
    one, two = data[at + 1], data[at + 1].astype(np.int32) << 8 | data[at + 2]
    length = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(two, [0x7265, 0x7665, 0x6C6C]), 2, 0))
    at, length = at[length > 0], length[length > 0]
    begins[at + 1] = False
    begins[at + 1 + length] = True
    places = np.flatnonzero(begins)
    ends = np.append(places[1:], len(data))
    inked = kind[places] > 0
    return places[inked], ends[inked]


class Known(dict):
    """Ids of words, found for new ones by ``learn``; a bounded number: when it is full the older half goes."""

    def __init__(self, learn: Callable[[list[bytes]], Iterable[bytes]], most: int):
        self.learn, self.most = learn, most
        self.unknown: dict[bytes, None] = {}

    def __missing__(self, word: bytes) -> None:
        self.unknown[word] = None

    def lookup(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.__getitem__, words))
        if self.unknown:
            new = list(self.unknown)
            self.unknown.clear()
            self.update(zip(new, self.learn(new), strict=True))
            for k in [k for k, x in enumerate(found) if x is None]:
                found[k] = self[words[k]]
        if len(self) > self.most:
            for old in list(islice(self, len(self) // 2)):
                del self[old]
        return found


class WordIds:
    """Token ids of texts, with the ids of each distinct word found once.

    The tokenizer drops white space, lower-cases, and merges only inside runs of letters, single
    digits, contractions and runs of other characters, so a text's ids are those of these units. Texts of
    plain characters (printable ASCII and the accented letters up to U+017F) are cut into units
    here; others, where normalisation can move a border, at white space only. Units and words are
    encoded once and kept. Texts that spell out a special token, in capitals or not, go to the tokenizer whole.
    """

    # byte pairs among the plain characters' that are no letters (multiplication and division sign), or
    # become two characters in lower case (capital I with dot)
    ODD_PAIRS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
    PLAIN = bytes([*b"\t\n\x0b\x0c\r", *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.units, self.words = Known(self._units, most), Known(self._words, most)

    def _units(self, words: list[bytes]) -> Iterable[bytes]:
        """Encode units of plain text, many in one go: a unit's last id, and only that, is one of a word end."""
        groups = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        made = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in made])
        cuts = (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist()
        raw = ids.tobytes()
        return (raw[at:to] for at, to in zip([0, *cuts], cuts, strict=False))

    def _words(self, words: list[bytes]) -> Iterable[bytes]:
        """Encode words of any text, one by one."""
        made = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return (np.array(x.ids, dtype="<u4").tobytes() for x in made)

    def _plain(self, raws: list[bytes]) -> list[bytes]:
        """The ids of texts of plain characters: cut and counted together, each distinct unit looked up once."""
        data = _LOW[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        start, end = units(data)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [
            None, pa.py_buffer(offsets), pa.py_buffer(data[_KIND[data] > 0])]).dictionary_encode()
        code = coded.indices.to_numpy()
        found = self.units.lookup(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        upto = np.concatenate([[0], np.cumsum(size[code])])
        ids = flat[np.repeat(first[code] - upto[:-1], size[code]) + np.arange(upto[-1])]
        begin = np.cumsum([0, *(len(x) + 1 for x in raws)])
        bounds = upto[np.searchsorted(start, begin)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        made: list[bytes] = [b""] * len(texts)
        plain, raws = [], []
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            if b"<|" in raw and any(s in raw.lower() for s in self.specials):
                made[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif raw.translate(None, self.PLAIN) or any(x in raw for x in self.ODD_PAIRS):
                # words as written: a letter and its mark may join in one case only
                made[i] = b"".join(self.words.lookup(raw.split()))
            else:
                plain.append(i)
                raws.append(raw)
        if raws:
            for i, ids in zip(plain, self._plain(raws), strict=True):
                made[i] = ids
        return made


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process (its cache serves all of the worker's tasks)."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, size: int, path: str | None, id_col: str, text_col: str,
                 keep_ids: bool, order_col: str | None = None) -> DataFrame:
    """One row for each piece of each document, with its rank among the task's pieces of its length.

    With ``order_col`` also the document's ``position``, its value there.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path or tokenizer_path())
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in text_batches(batches, most_bytes=2 << 20):
            rows, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, data in enumerate(ids_of.encode(batch.column("text").to_pylist())):
                data += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data) // 4, size)):
                    own = data[4 * at:4 * (at + size)]
                    n = len(own) // 4
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(own, dtype="<i4"))
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                   pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if keep_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if order_col:
                out.append(batch.column("position").take(pa.array(rows, pa.int64())))
                names.append("position")
            yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *([F.col(f"`{order_col}`").cast("long").alias("position")] if order_col else []))
    return reaching(rows).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
        + (", ids array<int>" if keep_ids else "") + (", position long" if order_col else ""))


def fullest(left: np.ndarray, anchor: int, size: int) -> dict[int, int]:
    """The lengths, ``anchor`` among them, that fill ``size`` as far as any choice can.

    Subset sums as a bit set: bit s is set if some choice has the sum s. Lengths come
    in descending order, a length's many copies in doubling bundles; the set before each
    bundle is kept to find the choice again. Stops once the rest can be filled exactly.
    """
    rest = size - anchor
    chosen = {anchor: 1}
    if not rest:
        return chosen
    within = (1 << rest + 1) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(left[: rest + 1])[::-1].tolist():
        copies = min(int(left[length]) - (length == anchor), rest // length)
        bundle = 1
        while copies > 0:
            take = min(bundle, copies)
            steps.append((length, take, reach))
            reach |= reach << length * take & within
            copies -= take
            bundle *= 2
        if reach >> rest:
            break
    total = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass
class Plan:
    """For each length, how its pieces, by rank, are dealt to sequences (arrays by run of ranks)."""

    first: dict[int, list[int]] = field(default_factory=dict)  # first rank of a run
    uses: dict[int, list[int]] = field(default_factory=dict)  # pieces of the length in each sequence
    sequence: dict[int, list[int]] = field(default_factory=dict)  # the run's first sequence
    offset: dict[int, list[int]] = field(default_factory=dict)  # where they begin in it
    sequences: int = 0


def minimum_bin_slack(counts: dict[int, int], size: int) -> Plan:
    """Deal ``counts`` pieces of each length to sequences of at most ``size``.

    Sequence by sequence: the longest length left is the anchor, and the fullest
    feasible choice around it is taken and removed. Taking pieces away never makes
    a fuller choice possible, so a choice is taken as often in a row as the counts allow.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan, dealt = Plan(), dict.fromkeys(counts, 0)
    while (held := np.flatnonzero(left)).size:
        chosen = fullest(left, int(held[-1]), size)
        times = min(int(left[x]) // n for x, n in chosen.items())
        at = 0
        for length, n in sorted(chosen.items(), reverse=True):
            for name, value in (("first", dealt[length]), ("uses", n), ("sequence", plan.sequences), ("offset", at)):
                getattr(plan, name).setdefault(length, []).append(value)
            dealt[length] += n * times
            left[length] -= n * times
            at += length * n
        plan.sequences += times
    return plan


@dataclass
class Runs:
    """The plan run by run: how often each choice is taken, and what it holds."""

    times: np.ndarray
    first: np.ndarray  # the plan's number of the run's first sequence
    holds: list[list[tuple[int, int, int]]]  # (length, pieces of it, where they begin)
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # the runs that use a length, and their pieces of it

    @classmethod
    def of(cls, plan: Plan) -> Runs:
        first = np.array(sorted({x for own in plan.sequence.values() for x in own}), dtype=np.int64)
        holds: list[list[tuple[int, int, int]]] = [[] for _ in first]
        by_length = {}
        for length, own in plan.sequence.items():
            runs = np.searchsorted(first, own)
            by_length[length] = (runs, np.array(plan.uses[length], dtype=np.int64))
            for run, n, at in zip(runs, plan.uses[length], plan.offset[length], strict=True):
                holds[run].append((length, n, at))
        return cls(np.diff(np.append(first, plan.sequences)), first, holds, by_length)

    def slots(self, made: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, rank, made, offset) of the pieces of the sequences with these numbers in the plan.

        The i-th of a run's n sequences stands at (2i + 1) / 2n of the way, the earlier run
        first at the same place. So every run is dealt out evenly, and a length's pieces go
        by rank to the sequences that hold it, in that order.
        """
        most = max(1, (1 << 20) // max(1, len(self.times)))
        of = np.searchsorted(self.first, made, side="right") - 1
        for run in np.unique(of).tolist():
            every = made[of == run]
            own = self.times[run]
            for begin in range(0, len(every), most):
                these = every[begin:begin + most]
                way = (2 * (these - self.first[run]) + 1)[:, None] * self.times - own
                # of each run, the sequences that stand before: strictly for the later runs
                before = np.where(np.arange(len(self.times)) < run, way // (2 * own) + 1, -(-way // (2 * own)))
                before = np.clip(before, 0, self.times)
                for length, n, at in self.holds[run]:
                    runs, uses = self.by_length[length]
                    rank = before[:, runs] @ uses
                    k = np.arange(n)
                    yield (np.full(len(these) * n, length), (rank[:, None] + k).ravel(), np.repeat(these, n),
                           np.tile(at + k * length, len(these)))


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, read from files that Spark wrote, with the row's place in the written order as column ``name``.

    Reading keeps no order, as splits are packed by size. But a writer's files carry the
    number of the task and of its file, and a sort leaves ascending ranges to its tasks; so a row's
    place is the number of rows in the files before, and its index in its own file.
    """
    file = docs.metadataColumn("_metadata")["file_name"]
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("long")
    keys = {"_part": number(r"^part-(\d+)"), "_count": number(r"-c(\d+)\."), "_file": file}
    # one row for each file
    files = docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    index = docs.metadataColumn("_metadata")["row_index"]
    return docs.select("*", file.alias("_file"), index.alias("_index")).join(
        F.broadcast(starts), F.col("_file") == F.col("_of")).withColumn(
        name, F.col("_start") + F.col("_index")).drop("_file", "_index", "_of", "_start")


def placed_in_order(pieces: DataFrame, plan: Plan, kept: list[str]) -> DataFrame:
    """The pieces' places, where the plan's sequences follow the pieces' ``position``.

    Of one length, earlier pieces go to earlier sequences (see ``Runs.slots``); then
    the sequences are numbered by the mean position of their ids.
    """
    runs = pieces.sparkSession.sparkContext.broadcast(Runs.of(plan))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in runs.value.slots(batch.column("id").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["_length", "_rank", "made", "offset"])

    slots = reaching(pieces.sparkSession.range(plan.sequences)).mapInArrow(
        deal, "_length long, _rank long, made long, offset long")
    by_rank = ranked(pieces.select(*kept, "position"), ["position", "piece"], by=["length"], name="piece-ranks")
    placed = written(by_rank.join(slots, (F.col("length") == F.col("_length")) & (F.col("pos") == F.col("_rank"))).select(
        *kept, "position", "made", "offset"), "placed")
    means = placed.groupBy("made").agg((F.sum(F.col("length") * F.col("position")) / F.sum("length")).alias("mean"))
    numbers = ranked(means, ["mean", "made"], name="sequence-order").select(
        F.col("made").alias("_made"), F.col("pos").alias("sequence_id"))
    return placed.join(numbers, F.col("made") == F.col("_made")).select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, size: int = 4096, path: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """Pack all documents' token ids into few sequences of at most ``size`` ids.

    A document's ids end with id 1; only longer ones are cut, into pieces of ``size``
    of which the last may be shorter. The pieces are tokenized and written once.
    Which lengths share a sequence is decided on the table of piece counts by length (at
    most ``size`` rows, however many documents), by minimum bin slack; each piece then
    finds its place from its rank among the pieces of its length, which needs only
    counts by task and length.

    With ``order_col``, a column of whole numbers, the sequences follow that order: pieces of
    one length are handed out by it, evenly over the plan's choices, and sequences are
    numbered by the mean place of what they hold. Their number and fill stay the same.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with
    ``keep_ids``), one row per piece. Cases: null and empty texts are the one id 1; rows of
    equal or null id are documents of their own; an empty table gives no rows;
    other columns are ignored.
    """
    pieces = written(token_pieces(docs, size, path, id_col, text_col, keep_ids, order_col), "pieces")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    by_task = written(pieces.groupBy("task", "length").agg((F.max("rank") + 1).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = minimum_bin_slack(counts, size)
    if order_col:
        return placed_in_order(pieces, made, kept)
    plan = docs.sparkSession.sparkContext.broadcast(made)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"),
                            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    by_rank = pieces.join(starts, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).select(
        *kept, (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                n = int(lengths[at[0]])
                if n not in runs:
                    p = plan.value
                    runs[n] = [np.array(x[n]) for x in (p.first, p.uses, p.sequence, p.offset)]
                first, uses, begins, places = runs[n]
                run = np.searchsorted(first, ranks[at], side="right") - 1
                past = ranks[at] - first[run]
                sequence[at] = begins[run] + past // uses[run]
                offset[at] = places[run] + past % uses[run] * n
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in by_rank.schema if f.name != "rank")
    return reaching(by_rank).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids) from ``pack_documents(..., keep_ids=True)``."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
        .alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
