"""Token-id output: documents as files of entropy-coded ids, and a Python data source that reads them.

Documents are dealt into ranges of ascending id, one file each; a file's ids run on from document to document
and are coded in independent blocks, in groups that are read one at a time (see ``token_coder``). Little-endian
format of a file: "TFID", version byte 2, 3 zero bytes; the groups; for each document int64 id, uint8 is it null,
int64 ids before it in the file, int64 ids; uint64 documents, uint64 ids, uint64 offset of these rows, "TFIX". Files have random names and count only if the manifest,
a table in the same folder, lists them, so lost or repeated tasks leave nothing that is read. The manifest's
order is the documents' order; a document's start is the ids of the files before plus those before it in
its file.

Nulls count as empty texts, of the end id alone; documents with a null id come first. Repeated rows are documents
of their own. An empty table writes an empty manifest.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import open_fs, work_dir
from .token_coder import BLOCK, LANES, pack, unpack

#: Bytes of input that one file is to take, by Spark's estimate.
FILE_BYTES = 128 << 20
MAGIC, TAIL = b"TFID\x02\0\0\0", b"TFIX"
_TAIL = "<QQQ4s"
_INDEX = np.dtype([("id", "<i8"), ("none", "u1"), ("start", "<i8"), ("n", "<i8")])


#: What the file's pre-tokenizer takes as one word, after composition and lower-casing.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: White space among the characters of Latin-1, as the pattern's ``\s`` has it.
_BLANKS = " \t\n\v\f\r\x85\xa0"
#: By character of Latin-1, where composition changes nothing and case goes letter by letter: what the pattern takes it for.
_KIND = np.array([_SPACE if c in _BLANKS else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER) for c in map(chr, range(256))], np.uint8)
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))
#: Characters of texts that are taken apart at once.
_AT_ONCE = 8 << 20


class WordTokenizer:
    """Ids of texts by a tokenizers file whose model drops white space, and so never crosses a space or line feed.

    Words are encoded one by one and the frequent ones remembered, with the same ids as the whole text has: about
    ``words`` words, or 64 times as many bytes, then a new memory. Texts in Latin-1, if the
    file splits by letters as we know how to, are taken apart many at once into the words of the file itself; other
    texts at spaces and line feeds.
    """

    def __init__(self, path: str, words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.own, self.room = Tokenizer.from_file(path), words
        self.forget()
        own = json.loads(self.own.to_str())
        steps = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.latin = (own.get("normalizer") or {}).get("normalizers") == _STEPS and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
        probe = "ab  cd\n\nab ' s <|x 1\n2"
        whole = self.own.encode(probe, add_special_tokens=False).ids
        self.by_word = whole == [i for w in re.split(r"[ \n]", probe) for i in self.own.encode(w, add_special_tokens=False).ids]
        # An added token no text is likely to hold marks where words end when many are encoded at once.
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        added = [t.content for t in self.own.get_added_tokens_decoder().values() if t.special and not re.search(r"\s", t.content)]
        self.mark = added[-1] if added else None
        self.mark_id = self.own.token_to_id(self.mark) if added else None
        # Where the model marks the last piece of a word, that shows where words end.
        suffix = own["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.own.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.path, self._odd = path, None

    def odd(self) -> WordTokenizer:
        """The one for texts beyond Latin-1."""
        if self._odd is None:
            self._odd = WordTokenizer(self.path, self.room)
        return self._odd

    def forget(self) -> None:
        """An empty memory: words, as bytes with the white space behind them, and where their ids begin in ``ids``."""
        import pyarrow as pa

        self.words = pa.array([b""], pa.large_binary())
        self.ids, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, words: list[str], units: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); ``units`` are words of the file itself, not split any further."""
        if units and self.ends is not None:
            ids = np.array(self.own.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
                return ids, np.diff(ends, prepend=0)
        if self.mark is None or any(self.mark in w for w in words):
            found = [e.ids for e in self.own.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        ids = np.array(self.own.encode_batch_fast([f" {self.mark} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        marks = ids == self.mark_id
        return ids[~marks], np.diff(np.concatenate([np.flatnonzero(marks), [len(ids)]]), prepend=-1) - 1

    def _places(self, words, units: bool) -> np.ndarray:
        """The memory's place of each of an Arrow array of distinct words; those not known are encoded in one call."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # The memory is looked up among the words, of which there are fewer, and not the other way round.
        hit = pc.index_in(self.words, value_set=words)
        there = np.asarray(hit.is_valid())
        out = np.full(len(words), -1, np.int64)
        out[hit.drop_null().to_numpy()] = np.flatnonzero(there)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new = words.take(pa.array(missing))
        plain = [w.decode("latin-1" if units else "utf-8").rstrip(_BLANKS) for w in new.to_pylist()]
        # White space alone has no ids.
        full = np.array([bool(w) for w in plain])
        count = np.zeros(len(plain), np.int64)
        ids, count[full] = self._encode([w for w in plain if w], units) if full.any() else (np.zeros(0, np.uint32), 0)
        at, before = len(self.count), len(self.ids)
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, before + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        out[missing] = np.arange(at, at + len(plain))
        return out

    def _cut(self, texts: list[str]):
        """(distinct words, which of them come one after another, how many words each text has) of Latin-1 texts."""
        import pyarrow as pa

        joined = "\n".join(texts).encode("latin-1").translate(_LOWER)
        raw = np.frombuffer(joined, np.uint8)
        kind = _KIND[raw]
        # A word starts where the kind changes or at a number; the white space behind it counts as its own.
        new = np.empty(len(raw), bool)
        new[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == _NUMBER
        new &= kind != _SPACE
        new[:1] = True
        if b"'" in joined:
            quotes = np.flatnonzero((raw == 39) & new)
            ahead = np.append(raw, np.zeros(2, np.uint8))
            a, b = ahead[quotes + 1], ahead[quotes + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            new[quotes[one | two] + 1] = False
            after = np.concatenate([quotes[one] + 2, quotes[two] + 3])
            after = after[after < len(raw)]
            new[after] |= kind[after] != _SPACE
        start = np.flatnonzero(new)
        cuts = pa.py_buffer(np.append(start, len(raw)).astype(np.int64))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, cuts, pa.py_buffer(joined)]).dictionary_encode()
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        place = np.searchsorted(start, first)
        return column.dictionary, column.indices.to_numpy(), np.diff(place)

    def _ids(self, words, which: np.ndarray, per_text: np.ndarray, units: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) for the words of the texts, ``per_text`` words each."""
        if len(self.words) > self.room or self.words.nbytes > 64 * self.room:
            self.forget()
        at = self._places(words, units)[which]
        count = self.count[at]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(self.begin[at] - upto + count, count) + np.arange(total)]
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(ends)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); nulls count as empty."""
        import pyarrow as pa

        out: list[np.ndarray | None] = [None] * len(texts)
        counts = np.zeros(len(texts), np.int64)
        group, size, odd = [], 0, []

        def flush() -> None:
            if group:
                ids, per_text = self._ids(*self._cut([texts[i] for i in group]), True)
                counts[group] = per_text
                for i, own in zip(group, np.split(ids, np.cumsum(per_text)[:-1])):
                    out[i] = own

        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif self.latin and self.by_word and (text.isascii() or _is_latin(text)) and not any(t in text for t in self.added):
                group.append(i)
                size += len(text)
                if size >= _AT_ONCE:
                    flush()
                    group, size = [], 0
            else:
                odd.append(i)
        flush()
        for i in odd:
            if self.by_word:
                words = pa.array([w.encode() for w in texts[i].replace("\n", " ").split(" ")], pa.large_binary()).dictionary_encode()
                # Their own memory: the same bytes mean other characters than in Latin-1.
                out[i] = self.odd()._ids(words.dictionary, words.indices.to_numpy(), np.array([len(words)]), False)[0]
            else:
                out[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            counts[i] = len(out[i])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    return WordTokenizer(path)


def manifest_of(path: str) -> str:
    """Where the manifest of the files below ``path`` is."""
    return f"{path}/manifest"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, append ``end_id``, write the ids in ascending order of the documents; returns the manifest
    (part, file, documents, ids, bytes)."""
    import pyarrow as pa
    from pyspark import TaskContext

    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    # Files of bounded size, whatever the session's number of shuffle partitions. What Spark can't estimate, such as
    # rows from the driver, it takes for larger than anything. Many rows of one id, or of none, are dealt by their texts.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.asc_nulls_first("id"), F.xxhash64("text")
    rows = rows.repartitionByRange(max(parts, -(-size // FILE_BYTES)) if size < 1 << 55 else parts, *order).sortWithinPartitions(*order)

    def run(batches):
        own, batch = tokenizer(tokenizer_path), next(batches, None)
        if batch is None:
            return
        file = f"{path}/tokens-{uuid.uuid4().hex}.tfid"
        fs, at = open_fs(file)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        index, pending, held, size = [], [], 0, len(MAGIC)
        with fs.open_output_stream(at, compression=None) as out:
            out.write(MAGIC)

            def flush(everything: bool) -> None:
                nonlocal pending, held, size
                data = np.concatenate(pending) if pending else np.zeros(0, np.uint32)
                n = len(data) if everything else len(data) - len(data) % (BLOCK * LANES)
                for group in pack(data[:n]):
                    out.write(group)
                    size += len(group)
                pending, held = [data[n:].copy()], len(data) - n

            while batch is not None:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    ids, counts = own.encode_batch(part.column(1).to_pylist())
                    if end_id is not None:
                        counts = counts + 1
                        whole, inner = np.full(len(ids) + len(counts), end_id, np.uint32), np.ones(len(ids) + len(counts), bool)
                        inner[np.cumsum(counts) - 1] = False
                        whole[inner] = ids
                        ids = whole
                    rows_ = np.zeros(len(counts), _INDEX)
                    rows_["id"], rows_["none"], rows_["n"] = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False), counts
                    index.append(rows_)
                    pending.append(ids)
                    held += len(ids)
                    if held >= BLOCK * LANES:
                        flush(False)
                batch = next(batches, None)
            flush(True)
            table = np.concatenate(index)
            table["start"] = np.cumsum(table["n"]) - table["n"]
            total = int(table["n"].sum())
            tail = table.tobytes() + struct.pack(_TAIL, len(table), total, size, TAIL)
            out.write(tail)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file], "documents": pa.array([len(table)], pa.int64()), "ids": pa.array([total], pa.int64()), "bytes": pa.array([size + len(tail)], pa.int64())})

    manifest = rows.mapInArrow(run, "part int, file string, documents bigint, ids bigint, bytes bigint")
    manifest.write.parquet(manifest_of(path))
    return docs.sparkSession.read.schema(manifest.schema).parquet(manifest_of(path))


def read_file(stream) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows of the index, their documents' ids) of one file, a group of blocks at a time; every block is compared
    with its checksum. ``stream`` is seekable."""
    size = stream.seek(0, 2)
    if size < len(MAGIC) + struct.calcsize(_TAIL):
        raise ValueError("not a token file, or one that was cut off")
    stream.seek(size - struct.calcsize(_TAIL))
    documents, total, at, tail = struct.unpack(_TAIL, stream.read(struct.calcsize(_TAIL)))
    stream.seek(0)
    if tail != TAIL or stream.read(len(MAGIC)) != MAGIC or at + documents * _INDEX.itemsize + struct.calcsize(_TAIL) != size:
        raise ValueError("not a token file, or one that was cut off")
    stream.seek(at)
    index = np.frombuffer(stream.read(documents * _INDEX.itemsize), _INDEX)
    stream.seek(len(MAGIC))
    ends, held, first, done = index["start"] + index["n"], np.zeros(0, np.uint32), 0, 0
    for ids in unpack(stream, at):
        held = np.concatenate([held, ids])
        # ``done`` ids went before those held.
        n = int(np.searchsorted(ends, done + len(held), side="right"))
        if n > first:
            yield index[first:n], [held[s - done : e - done] for s, e in zip(index["start"][first:n].tolist(), ends[first:n].tolist())]
            held, done, first = held[int(ends[n - 1]) - done :], int(ends[n - 1]), n
    if done + len(held) != total:
        raise ValueError("a token file isn't as long as it says")
    if first < documents:
        # Documents without ids, of a file that holds none.
        yield index[first:], [held[:0]] * (documents - first)


class FilePartition(InputPartition):
    def __init__(self, part: int, file: str):
        self.part, self.file = part, file


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        import pyarrow.parquet as pq

        fs, path = open_fs(self.options["manifest"])
        table = pq.read_table(path, columns=["part", "file"], filesystem=fs).to_pydict()
        return [FilePartition(p, f) for p, f in sorted(zip(table["part"], table["file"]))]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:
            return
        fs, path = open_fs(partition.file)
        whole = self.options.get("ids", "true").lower() == "true"
        with fs.open_input_file(path) as stream:
            for index, rows_ in read_file(stream):
                for lo in range(0, len(index), 1024):
                    part, rows = index[lo : lo + 1024], rows_[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), partition.part, np.int32)),
                            pa.array(part["id"], mask=part["none"] != 0),
                            pa.array(part["start"]),
                            pa.array(part["n"]),
                            pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                            pa.array([r.astype(np.int64) for r in rows] if whole else [None] * len(rows), pa.list_(pa.int64())),
                        ],
                        names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )


class TokenDataSource(DataSource):
    """Options: ``manifest`` (what ``write_tokens`` left); ``ids`` = ``false`` leaves the ids themselves out. ``start``
    counts within the file."""

    @classmethod
    def name(cls) -> str:
        return "tokenids"

    def schema(self) -> str:
        return "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in the files below ``path``."""
    spark.dataSource.register(TokenDataSource)
    files = spark.read.parquet(manifest_of(path))
    # One row for each file.
    before = files.select(F.col("part").alias("p"), (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    rows = spark.read.format("tokenids").options(manifest=manifest_of(path), ids=str(ids).lower()).load()
    return rows.join(before, F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op7_token_files(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of all documents, read the files back: each document's place, length and checksum."""
    import public_tokenizers

    folder = work_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder, ids=False).drop("ids")
