"""Language-model scoring with a log-bilinear neural model.

Words outside a shortlist of the most frequent ones are dealt into classes by
their last letters. The model gives the next class from the two before it: each
context position has a matrix that its class's vector is multiplied by, the sum
predicts a vector, and its products with the classes' output vectors, plus
biases, are the scores (log-bilinear). A word's probability is that of its class
times its add-one share of the class, in which unseen words are one kind more,
so the probabilities of all words sum to one.

Counts cover every training document: word counts and counts of class triples
are gathered by Spark. Noise-contrastive estimation works on the triple counts
of all documents, with the expected share of noise in closed form, in rounds:
each task improves the parameters on its contexts in numpy, and the tasks'
parameters are averaged. Scoring normalises with batched matrix products over
each chunk's distinct contexts.

A document's words look their counts up through its chunk: a chunk of text has
a dictionary, the dictionary's words meet their counts by a shuffle on words,
and return to the chunk. Chunks are of bounded size, so nothing grows with the
corpus but the number of rows; only class totals and the shortlist, whose
lengths are parameters, reach the driver.

Null and empty texts have the end token alone. A null doc_id counts as training.
Repeated rows count and are scored each. Very long texts are chunks of their
own. Words of equal count go onto the shortlist in their own order. Other columns
don't matter, whatever their names. An empty table gives no rows; without training
documents every count is 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import group_sums, slices, split_words, table, texts, written

CHUNK_BYTES = 8 << 20
END = "\n"  # no word holds a line feed
SHORTLIST, REST, DIM = 95, 32, 24
CLASSES = 1 + SHORTLIST + REST  # class 0 is the end, and the context before a text


def suffix_classes(words: pa.Array) -> np.ndarray:
    """The class of each word that is not on the shortlist: by its last three letters, marks at the end left out."""
    bare = pc.utf8_rtrim(words, characters=".,;:!?\"')*#$%&|")
    found: dict[str, int] = {}
    ends = pc.utf8_slice_codeunits(bare, -3, 1 << 30).to_pylist()
    for e in set(ends):
        found[e] = 1 + SHORTLIST + zlib.crc32(e.encode()) % REST
    return np.fromiter(map(found.__getitem__, ends), np.int32, len(ends))


@dataclass
class Model:
    """Parameters; float32 arrays."""

    inner: np.ndarray  # vector of each class as context
    turn: np.ndarray  # matrix of each of the two positions
    outer: np.ndarray  # vector of each class as the next one
    bias: np.ndarray
    shortlist: list[str] = field(default_factory=list)

    @classmethod
    def fresh(cls, noise: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        turn = np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32) * 0.5
        return cls(small(CLASSES, DIM), turn, small(CLASSES, DIM), np.log(noise).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.inner, self.turn, self.outer, self.bias]

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return self.inner[context // CLASSES] @ self.turn[0] + self.inner[context % CLASSES] @ self.turn[1]

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """Rows of natural log-probabilities of every next class."""
        scores = (self.predicted(context) @ self.outer.T + self.bias).astype(np.float64)
        top = scores.max(axis=1, keepdims=True)
        return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))


def improve(model: Model, context: np.ndarray, counts: np.ndarray, noise: np.ndarray, epochs: int, ratio: float, rate: float, seed: int) -> Model:
    """NCE by Adam over contexts with their counts of next classes; ratio: noise draws a token, in expectation."""
    rng = np.random.default_rng(seed)
    params = [a.copy() for a in model.arrays()]
    moment, power = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    now = Model(*params)
    offset = np.log(ratio * noise).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(context))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            n = counts[rows]
            a, b = context[rows] // CLASSES, context[rows] % CLASSES
            guess = now.predicted(context[rows])
            true = 1 / (1 + np.exp(-np.clip(guess @ now.outer.T + now.bias - offset, -30, 30)))
            slope = n * (1 - true) - n.sum(axis=1, keepdims=True) * (ratio * noise) * true
            slope = (slope / n.sum()).astype(np.float32)
            back = slope @ now.outer
            grads = [np.zeros_like(x) for x in params]
            np.add.at(grads[0], a, back @ now.turn[0].T)
            np.add.at(grads[0], b, back @ now.turn[1].T)
            grads[1][0] = now.inner[a].T @ back
            grads[1][1] = now.inner[b].T @ back
            grads[2] = slope.T @ guess
            grads[3] = slope.sum(axis=0)
            step += 1
            for p, g, m, v in zip(params, grads, moment, power):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return now


def _dictionaries(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: documents as codes in their chunk's dictionary, and the dictionaries with training counts."""
    kinds = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("suffix", pa.int32())])

    def work(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 28
        for part in slices(batches, "text", chunk_bytes):
            codes, bounds, words = split_words(pc.ascii_lower(texts(part)))
            learn = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(codes[np.repeat(learn, np.diff(bounds))], minlength=len(words))
            body = codes.astype("<i4").tobytes()
            coded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(body)])
            rows = {"kind": np.zeros(part.num_rows, np.int32), "chunk": np.full(part.num_rows, chunk), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "codes": coded}
            yield from _filled(rows, part.num_rows, kinds)
            size = len(words) + 1
            named = pa.concat_arrays([words.cast(pa.string()), pa.array([END], pa.string())])
            rows = {"kind": np.ones(size, np.int32), "chunk": np.full(size, chunk), "code": np.arange(size, dtype=np.int32), "word": named, "n": np.append(n, learn.sum()).astype(np.int64), "suffix": np.append(suffix_classes(words), 0).astype(np.int32)}
            yield from _filled(rows, size, kinds)
            chunk += 1

    return docs.mapInArrow(work, "kind int, chunk bigint, doc_id bigint, held_out boolean, codes binary, code int, word string, n bigint, suffix int")


def _filled(rows: dict, size: int, schema: pa.Schema):
    columns = [pa.array(rows[f.name], f.type) if f.name in rows and not isinstance(rows[f.name], pa.Array) else rows.get(f.name, pa.nulls(size, f.type)) for f in schema]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=50_000)


def _triples(docs: DataFrame, shortlist: list[str]) -> DataFrame:
    """Counts of (two classes, next class) over the rows of docs, as context and one row per next class."""

    def work(batches):
        known = pa.array(shortlist, pa.large_string())
        held: list[np.ndarray] = []
        waiting = 0

        def flush():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // CLASSES).astype(np.int32)), pa.array((code % CLASSES).astype(np.int32)), pa.array(n.astype(np.int64))], names=["context", "next", "n"])

        for part in slices(batches):
            codes, bounds, words = split_words(pc.ascii_lower(texts(part)))
            held.append(sequences(classes_of(words, known)[codes] if len(codes) else codes, bounds)[0].astype(np.int32))
            waiting += len(held[-1])
            if waiting > 4_000_000:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(work, "context int, next int, n bigint").groupBy("context", "next").agg(F.sum("n").alias("n"))


def classes_of(words: pa.Array, shortlist: pa.Array) -> np.ndarray:
    at = pc.index_in(words, shortlist)
    short = np.asarray(pc.fill_null(at, -1))
    return np.where(short >= 0, short + 1, suffix_classes(words)).astype(np.int32)


def sequences(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (context and next class) of every token, each text ended by class 0; and the texts' bounds in them."""
    sizes = np.diff(bounds)
    ends = bounds + np.arange(len(bounds))
    token = np.zeros(int(ends[-1]), np.int64)
    token[np.arange(len(classes)) + np.repeat(np.arange(len(sizes)), sizes)] = classes
    place = np.arange(len(token)) - np.repeat(ends[:-1], sizes + 1)
    one = np.where(place >= 1, np.concatenate([[0], token[:-1]]), 0)
    two = np.where(place >= 2, np.concatenate([[0, 0], token[:-2]])[: len(token)], 0)
    return (two * CLASSES + one) * CLASSES + token, ends


def train(triples: DataFrame, shortlist: list[str], rounds: int = 6, parts: int = 6, epochs: int = 4, ratio: float = 16.0) -> Model:
    """A model from triple counts, whose number of rows CLASSES bounds. ``parts`` tasks work at a time, and their parameters are averaged after each of the rounds."""
    seen = dict(triples.groupBy("next").agg(F.sum("n")).collect())  # as many rows as classes
    noise = np.array([seen.get(c, 0) + 1.0 for c in range(CLASSES)])
    noise = (noise / noise.sum()).astype(np.float32)
    model = Model.fresh(noise)
    shapes = [a.shape for a in model.arrays()]
    if not seen:
        return Model(*model.arrays(), shortlist)

    def local(batches, start, turn):
        rows = pa.Table.from_batches(list(batches)) if batches else None
        if rows is None or not rows.num_rows:
            return
        context, next_, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("context", "next", "n"))
        own, back = np.unique(context, return_inverse=True)
        counts = np.zeros((len(own), CLASSES), np.float32)
        counts[back, next_] = n
        done = improve(Model(*start), own.astype(np.int64), counts, noise, epochs, ratio, 0.01 * 0.6**turn, turn)
        flat = np.concatenate([a.ravel() for a in done.arrays()]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([float(counts.sum())]), pa.array([flat], pa.binary())], names=["weight", "flat"])

    dealt = triples.repartition(parts, "context")
    for turn in range(rounds):
        start = model.arrays()
        found = dealt.mapInArrow(lambda b, s=start, t=turn: local(list(b), s, t), "weight double, flat binary").collect()  # one row a part
        mean = sum(np.frombuffer(r["flat"], "<f4").astype(np.float64) for r in found) / len(found)
        arrays, at = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            arrays.append(mean[at : at + size].reshape(shape).astype(np.float32))
            at += size
        model = Model(*arrays)
    return Model(*model.arrays(), shortlist)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; learns from those not held out."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    coded = written(_dictionaries(named, chunk_bytes), "lm-chunks", "zstd")  # the largest table that is kept
    named_words = coded.where("kind = 1").select("chunk", "code", "word", "suffix", "n")
    # a row a word: a common one has as many rows before as there are chunks, and none is gathered
    words = written(named_words.groupBy("word").agg(F.sum("n").alias("c"), F.min("suffix").alias("suffix")), "lm-words")
    known = words.where("c > 0")
    tokens, kinds = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = known.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(SHORTLIST).select("word").collect()
    shortlist = [r["word"] for r in short]
    listed = spark.createDataFrame([(w, i + 1) for i, w in enumerate([*shortlist])], "word string, short int")  # at most SHORTLIST rows
    classed = words.join(F.broadcast(listed), "word", "left").withColumn("class", F.when(F.col("word") == END, 0).otherwise(F.coalesce("short", "suffix"))).select("word", "c", "class")
    rest = classed.where(f"c > 0 and class > {SHORTLIST}").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = np.ones(CLASSES)  # of a class: its tokens, its words and one for what is unseen
    for r in rest:
        mass[r["class"]] += r["c"] + r["n"]
    model = train(written(_triples(named.where("not held_out").select("text"), shortlist), "lm-triples"), shortlist)

    def work(t: pa.Table, mine: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        size = mine.num_rows
        code = np.asarray(mine.column("code").combine_chunks())
        count, cls = np.zeros(size), np.zeros(size, np.int32)
        count[code] = np.asarray(mine.column("c").combine_chunks())
        cls[code] = np.asarray(mine.column("class").combine_chunks())
        made = []
        for part in (p for b in t.combine_chunks().to_batches() for p in slices([b], "codes", 4 << 20)):
            lengths = np.asarray(pc.fill_null(pc.binary_length(part.column("codes")), 0), np.int64) // 4
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), "<i4")
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            sequence, ends = sequences(cls[codes], bounds)
            all_counts = np.full(len(sequence), count[size - 1])
            all_counts[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = count[codes]
            context, at = np.unique(sequence // CLASSES, return_inverse=True)
            next_ = sequence % CLASSES
            logs = model.log_probabilities(context)[at, next_] / np.log(10)
            inside = np.where(next_ > SHORTLIST, np.log10((all_counts + 1) / mass[next_]), 0.0)
            base = np.log10((all_counts + 1) / (tokens + 1.0 * (kinds + 1)))
            made.append(pa.table([
                part.column("doc_id"), part.column("held_out"), pa.array(np.diff(ends)), pa.array(group_sums((all_counts > 0).astype(np.int64), ends)),
                pa.array(np.full(part.num_rows, tokens, np.int64)), pa.array(_sums(base, ends)), pa.array(_sums(logs + inside, ends)),
            ], names=names))
        return pa.concat_tables(made) if made else pa.table({n: pa.array([], x) for n, x in zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})

    left = coded.where("kind = 0").select("chunk", "doc_id", "held_out", "codes").groupBy("chunk")
    right = named_words.select((F.col("chunk") + 0).alias("chunk"), "code", "word").join(classed, "word").select("chunk", "code", "c", "class").groupBy("chunk")  # a column of its own, as both sides come from one table
    return left.cogroup(right).applyInArrow(work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs that are never empty, each summed by itself so that no rounding passes from one to the next."""
    return np.add.reduceat(values, ends[:-1]) if len(ends) > 1 else np.zeros(0)


def op10_lm_scoring(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
