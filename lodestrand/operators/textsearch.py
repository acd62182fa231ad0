"""Text retrieval in DataFrames: tokens, BM25, a multi-clause relevance score, phrases, near terms, highlights.

The score is this engine's own: BM25 with k1 = 1.2 and b = 0.75 over lower-cased letter and digit runs without stop
words, and a sum of boosted clauses.  A corpus is tokenised once, into a kept index of positional postings (and, if asked
for, of runs of three characters); queries read the postings of their terms from it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.sources.sinks import new_folder, staged

#: The default English stop words of common analyzers, and folded letters.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
ACCENTED = "àâäáãåçèéêëìíîïñòóôöõùúûüÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuy"

#: Boosts of the clauses and the share of terms that the OR clause needs.
BOOSTS = {"phrase": 8.0, "all": 5.0, "most": 3.0, "fuzzy": 2.0, "ngram": 2.5, "wildcard": 1.0}
SHARE = 0.6
K1, B = 1.2, 0.75


def tokens(text: Column, fold: bool = True, stop: bool = True) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.replace(F.translate(low, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss")) if fold else low
    found = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop else found


def term_counts(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """key, term, tf, dl: one scan; only the terms of documents with any are kept."""
    toks = docs.select(key, tokens(F.col(text), **how).alias("_t")).withColumn("dl", F.size("_t"))
    return toks.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


#: Bytes of text for one task of an index, the least and most folders of postings, and terms that are looked up by name.
TASK_BYTES, LEAST_FOLDERS, MOST_FOLDERS, NAMED = 32 << 20, 32, 4096, 2000

#: Terms, and bytes of them, that a task brings together before it hands on their postings.
GROUP_TERMS, GROUP_BYTES = 2 << 20, 64 << 20


@dataclass(frozen=True)
class Postings:
    """Postings of one kind of term, in folders by hash of the term and sorted by term within; and the terms' document frequencies.

    A row of ``stored`` has a term's documents of one group: their keys, ``ends`` (sums of tf), lengths and, for words,
    all their positions one after another.
    """

    stored: DataFrame
    vocabulary: DataFrame
    folders: int
    documents: int
    mean_length: float
    key: str

    @property
    def rows(self) -> DataFrame:
        """term, key, tf, dl and, for words, positions: a row for each term and document."""
        return self._each(self.stored.drop("folder"), [], True)

    def _each(self, found: DataFrame, more: list[str], positions: bool) -> DataFrame:
        ends = F.col("ends")

        def document(i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            tf = F.get(ends, i) - before
            places = [F.slice("positions", before + 1, tf).alias("positions")] if positions and "positions" in found.columns else []
            return F.struct(F.get("keys", i).alias(self.key), tf.cast("long").alias("tf"), F.get("dl", i).alias("dl"), *places)

        each = F.explode(F.transform(F.sequence(F.lit(0), F.col("df") - 1), document)).alias("_d")
        return found.select("term", *more, each).select("term", "_d.*", *more)

    def _named(self, terms: list[str]) -> DataFrame:
        found = sorted({zlib.crc32(t.encode()) % self.folders for t in terms})
        return self.stored.where(F.col("folder").isin(found) & F.col("term").isin(terms)).drop("folder")

    def of(self, terms: list[str], positions: bool = True) -> DataFrame:
        """The postings of some terms: only their folders, and in these only the terms' row groups, are read."""
        return self._each(self._named(terms), [], positions)

    def joined(self, wanted: DataFrame, positions: bool = True) -> DataFrame:
        """Postings of the terms in a written table, whose columns are added; by name, if they are few."""
        few = wanted.select("term").distinct().limit(NAMED + 1).collect()
        rows = self._named([r["term"] for r in few]) if len(few) <= NAMED else self.stored.drop("folder")
        return self._each(rows.join(wanted, "term"), [c for c in wanted.columns if c != "term"], positions)


@dataclass(frozen=True)
class TextIndex:
    """A tokenised corpus: ``words`` (term, key, tf, dl, positions; stop words too, which dl leaves out) and, if asked for, ``grams`` (term, key, tf, dl).

    One that has n-grams alone serves ``ngram_hits``.
    """

    words: Postings | None
    grams: Postings | None = None

    @property
    def vocabulary(self) -> DataFrame:
        return self.words.vocabulary.where(~F.col("term").isin(STOP_WORDS))

    @property
    def documents(self) -> int:
        return self.words.documents

    @property
    def mean_length(self) -> float:
        return self.words.mean_length

    def of(self, terms: list[str]) -> DataFrame:
        return self.words.of(terms)


def _tasks(size: int) -> tuple[int, int]:
    """How many tasks and folders a corpus of ``size`` bytes asks for."""
    tasks = max(LEAST_FOLDERS, int(size // TASK_BYTES))
    return tasks, min(tasks, MOST_FOLDERS)


def _written(rows: DataFrame, key: str, folder: str, folders: int, documents: int, silent: tuple[str, ...] = ()) -> Postings:
    """Postings written by folders.

    ``silent`` terms don't count in the mean length.
    """
    spark = rows.sparkSession
    rows.sortWithinPartitions("folder", "term").write.partitionBy("folder").option("compression", "zstd").parquet(f"{folder}/postings")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/postings")
    kept.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).sortWithinPartitions("term").write.parquet(f"{folder}/vocabulary")
    vocabulary = spark.read.parquet(f"{folder}/vocabulary")
    total = vocabulary.where(~F.col("term").isin(list(silent))).agg(F.sum("cf")).first()[0]
    return Postings(kept, vocabulary.select("term", "df"), folders, documents, (total or 0) / max(documents, 1), key)


def _lists(code: np.ndarray, row: np.ndarray, keys: pa.Array, dl: pa.Array, at: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """The codes of the terms of some documents, and for each the columns keys, ends, dl, df, cf and positions.

    ``code`` and ``row``, the document's, stand in the order of documents and of places in them, ``at``.
    """
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    new = np.diff(code, prepend=code[:1] - 1) != 0
    head = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))
    first = np.flatnonzero(new[head])
    ends, begins = np.append(head[1:], len(code)), head[first]
    df, cf = np.diff(np.append(first, len(head))), np.diff(np.append(begins, len(code)))
    offsets, take = pa.array(np.append(first, len(head)), pa.int32()), pa.array(row[head])
    each = lambda values: pa.ListArray.from_arrays(offsets, values)
    out = [each(keys.take(take)), each(pa.array(ends - np.repeat(begins, df), pa.int32())), each(dl.take(take)), pa.array(df, pa.int32()), pa.array(cf, pa.int64())]
    if at is not None:
        out.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(code)), pa.int32()), pa.array(at[order], pa.int32())))
    return code[begins], out


def _posted(rows: DataFrame, key: str, group: Callable[[pa.Table], tuple[pa.Array, list[pa.Array]]], share: Callable[[pa.RecordBatch], float], positions: bool, tasks: int, folders: int) -> DataFrame:
    """Postings with their folder, in ``tasks`` partitions by folder: of some batches, ``group`` makes one row for each term.

    ``share`` is a batch's part of what is brought together.  The rows of a folder are shuffled as one compressed batch,
    which takes a third of their space: numbers of four and eight bytes, most of them zero, are nothing for a shuffle's codec.
    """
    kinds = [("term", T.StringType()), ("keys", T.ArrayType(rows.schema[key].dataType))]
    kinds += [("ends", T.ArrayType(T.IntegerType())), ("dl", T.ArrayType(T.IntegerType())), ("df", T.IntegerType()), ("cf", T.LongType()), ("positions", T.ArrayType(T.IntegerType()))]
    kinds = kinds[: 7 if positions else 6]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        term, lists = group(pa.Table.from_batches(held).combine_chunks())
        made = pa.record_batch([term, *lists], names=[c for c, _ in kinds])
        home = np.fromiter((zlib.crc32(t.encode()) % folders for t in term.to_pylist()), np.int32, len(term))
        order = np.argsort(home, kind="stable")
        made, home = made.take(pa.array(order)), home[order]
        head, data = np.flatnonzero(np.diff(home, prepend=-1)), []
        for i, n in zip(head.tolist(), np.diff(np.append(head, len(home))).tolist(), strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(made.slice(i, n))
            data.append(out.getvalue().to_pybytes())
        return pa.record_batch([pa.array(home[head]), pa.array(data, pa.binary())], names=["folder", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = [], 0.0
        for batch in batches:
            part = share(batch)
            if held and full + part > 1:
                yield packed(held)
                held, full = [], 0.0
            held.append(batch)
            full += part
        if held:
            yield packed(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, data in zip(batch["folder"].to_pylist(), batch["data"], strict=True):
                for made in pa.ipc.open_stream(data.as_buffer()):
                    yield made.append_column("folder", pa.array(np.full(len(made), folder, np.int32)))

    # A frequent term's documents are spread over the tasks of its folder.
    part = F.pmod(F.xxhash64("data"), F.lit(-(-tasks // folders)))
    sent = rows.mapInArrow(pack, "folder int, data binary").repartition(tasks, "folder", part)
    return sent.mapInArrow(unpack, T.StructType([T.StructField(c, t) for c, t in [*kinds, ("folder", T.IntegerType())]]))


def _word_postings(rows: DataFrame, key: str, tasks: int, folders: int) -> DataFrame:
    """Postings with positions of rows (key, dl, terms)."""

    def group(t: pa.Table) -> tuple[pa.Array, list[pa.Array]]:
        terms = t["terms"].combine_chunks()
        n = np.asarray(terms.value_lengths()).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code, lists = _lists(coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), t[key].combine_chunks(), t["dl"].combine_chunks(), at)
        return coded.dictionary.take(pa.array(code)), lists

    return _posted(rows, key, group, lambda b: max(len(b["terms"].flatten()) / GROUP_TERMS, b["terms"].nbytes / GROUP_BYTES), True, tasks, folders)


def _gram_postings(rows: DataFrame, key: str, tasks: int, folders: int) -> DataFrame:
    """Postings of the runs of three characters of rows (key, low): a run is a number, three code points of 21 bits."""

    def group(t: pa.Table) -> tuple[pa.Array, list[pa.Array]]:
        texts = t["low"].to_pylist()
        n = np.array([len(x) for x in texts], np.int64)
        char = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        # A run begins at all characters of a text but its last two.
        left = np.repeat(np.cumsum(n), n) - np.arange(len(char))
        at = np.flatnonzero(left > 2)
        code, row = char[at] << 42 | char[at + 1] << 21 | char[at + 2], np.repeat(np.arange(len(n)), n)[at]
        code, lists = _lists(code, row, t[key].combine_chunks(), pa.array(np.maximum(n - 2, 0), pa.int32()))
        low = (1 << 21) - 1
        all_ = np.stack([code >> 42, code >> 21 & low, code & low], 1).astype("<u4").tobytes().decode("utf-32-le")
        return pa.array([all_[i : i + 3] for i in range(0, len(all_), 3)], pa.string()), lists

    return _posted(rows, key, group, lambda b: b["low"].nbytes / GROUP_TERMS, False, tasks, folders)


def grams_of(text: Column, n: int = 3) -> Column:
    """All runs of n characters of the text in lower case, spaces and marks included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def _spread(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int]:
    """Keys and texts as they are tokenised, their number and bytes."""
    rows = docs.select(key, text)
    documents, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # A table of fewer files than there are cores is spread first; a larger one is tokenised where it is read.
    if len(docs.inputFiles()) < docs.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(key)
    return rows, documents, size


def build_words(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> Postings:
    """Postings of the words of ``docs``, with positions, written under the shared folder."""
    rows, documents, size = _spread(docs, key, text)
    words = rows.select(key, tokens(F.col(text), **{**how, "stop": False}).alias("terms"))
    said = F.filter("terms", lambda t: ~t.isin(STOP_WORDS)) if how.get("stop", True) else F.col("terms")
    tasks, folders = _tasks(size)
    words = _word_postings(words.select(key, F.size(said).alias("dl"), "terms"), key, tasks, folders)
    return _written(words, key, f"{new_folder(docs.sparkSession, 'text_index')}/words", folders, documents, tuple(STOP_WORDS) if how.get("stop", True) else ())


def build_grams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Postings:
    """Postings of all runs of three characters of ``docs`` in lower case, written under the shared folder."""
    rows, documents, size = _spread(docs, key, text)
    low = rows.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    tasks, folders = _tasks(2 * size)
    return _written(_gram_postings(low, key, tasks, folders), key, f"{new_folder(docs.sparkSession, 'text_index')}/grams", folders, documents)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", grams: bool = False, **how) -> TextIndex:
    """Tokenise ``docs`` (whose key is unique) once; the index is written under the shared folder.

    ``grams`` adds postings of all runs of three characters.
    """
    return TextIndex(build_words(docs, key, text, **how), build_grams(docs, key, text) if grams else None)


def _scored(posts: Postings, asked: list[tuple[int, str]], key: str) -> DataFrame:
    """query_id, key, score, matched, terms: BM25 over each query's terms, from their postings."""
    spark = posts.stored.sparkSession
    many = Counter(q for q, _ in asked)
    given = spark.createDataFrame([(q, t, many[q]) for q, t in asked], "query_id long, term string, terms long")
    wanted = sorted({t for _, t in asked})
    # A row for each term of the stated queries.
    given = given.join(posts.vocabulary.where(F.col("term").isin(wanted)), "term")
    idf = F.log(1 + (posts.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(posts.mean_length)))
    return posts.of(wanted, False).join(F.broadcast(given), "term").groupBy("query_id", key, "terms").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", index: TextIndex | None = None, **how) -> DataFrame:
    """query_id, key, score, matched, terms: BM25 over the query's distinct terms; the queries are a stated set.

    ``index`` is the kept index of ``docs``; without one it is built.
    """
    index = build_index(docs, key, text, **how) if index is None else index
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query"), **how))).alias("term"))
    return _scored(index.words, sorted({(r["query_id"], r["term"]) for r in terms.collect()}), key)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Case-insensitive containment; a blank phrase is in nothing."""
    p = F.lower(F.trim(phrase))
    return (F.length(p) > 0) & F.coalesce(F.contains(F.lower(text), p), F.lit(False))


def ngram_terms(queries: DataFrame) -> list[tuple[int, str]]:
    """(query_id, gram) of the stated queries: the runs of three characters of what is asked for without spaces around."""
    low = F.lower(F.trim("query"))
    rows = queries.select("query_id", F.explode(F.array_distinct(grams_of(low))).alias("gram")).collect()
    return sorted((r["query_id"], r["gram"]) for r in rows)


def ngram_hits(index: TextIndex, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key: the documents that hold every run of three characters of a stated query; a shorter query has none.

    A query's rarest gram gives the candidates; the postings of its other grams are counted for these only.
    """
    posts, asked = index.grams, ngram_terms(queries)
    spark = posts.stored.sparkSession
    given = spark.createDataFrame(asked, "query_id long, term string")
    given = given.join(posts.vocabulary.where(F.col("term").isin([g for _, g in asked])), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    given = staged(given.select("query_id", "term", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("query_id")).alias("need")))
    found = posts.joined(given, False)
    first = found.where("r = 1").select("query_id", key, "need")
    rest = found.where("r > 1").select("query_id", key).join(first, ["query_id", key]).groupBy("query_id", key, "need").agg(F.count("*").alias("n")).where("n = need - 1")
    return first.where("need = 1").select("query_id", key).unionByName(rest.select("query_id", key))


def has_ngram_field(index: TextIndex) -> bool:
    """Whether an index has n-grams beside its words; where it has none, containment is what runs."""
    return index.grams is not None


def fuzziness(term: Column) -> Column:
    """Edits allowed: 0 up to 2 letters, 1 up to 5, then 2."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def near_terms(vocabulary: DataFrame, terms: DataFrame, prefix: int = 1) -> DataFrame:
    """wanted, term, edits: vocabulary within the allowed Levenshtein distance, first letters equal.

    The join is on the prefix; a transposition counts as two edits.
    """
    a = terms.select(F.col("term").alias("wanted")).distinct().withColumn("_p", F.substring("wanted", 1, prefix))
    b = vocabulary.select("term").distinct().withColumn("_p", F.substring("term", 1, prefix))
    near = F.abs(F.length("wanted") - F.length("term")) <= fuzziness(F.col("wanted"))
    met = b.join(F.broadcast(a), "_p").where(near).withColumn("edits", F.levenshtein("wanted", "term"))
    return met.where(F.col("edits") <= fuzziness(F.col("wanted"))).select("wanted", "term", "edits")


def _pieces(queries: DataFrame, whole: bool) -> tuple[list[tuple[int, int, str, str]], list[int]]:
    """(query_id, offset, how, token) of stated phrases, and the queries without tokens.

    ``whole``: phrases of whole words, whose stop words only keep their places.  Otherwise a phrase may begin and end
    inside a word: its first token ends one, its last begins one, and one that is alone is inside one.
    """
    out, bare = [], []
    for r in queries.select("query_id", tokens(F.lower(F.trim("query")), stop=False).alias("t")).collect():
        words = list(enumerate(r["t"]))
        if whole:
            words = [(i, w) for i, w in words if w not in STOP_WORDS]
            out += [(r["query_id"], i, "is", w) for i, w in words]
        elif len(words) == 1:
            out.append((r["query_id"], 0, "inside", words[0][1]))
        else:
            out += [(r["query_id"], i, "ends" if i == 0 else "begins" if i == len(words) - 1 else "is", w) for i, w in words]
        if not words:
            bare.append(r["query_id"])
    return out, bare


def _at(index: TextIndex, pieces: list[tuple[int, int, str, str]], key: str) -> DataFrame:
    """query_id, key, start: where the pieces of a query's phrase stand side by side, by a join of positions.

    The piece with the fewest documents gives the places; the postings of the others are looked up for these only.
    """
    spark = index.words.stored.sparkSession
    need = Counter(q for q, *_ in pieces)
    term, vocabulary = F.col("term"), index.words.vocabulary
    test = {"is": lambda w: term == w, "ends": lambda w: F.endswith(term, w), "begins": lambda w: F.startswith(term, w), "inside": lambda w: F.contains(term, w)}
    if all(how == "is" for _, _, how, _ in pieces):
        vocabulary = vocabulary.where(term.isin([w for *_, w in pieces]))
    # All terms of the vocabulary that a piece can be, in one scan; pieces are those of the stated queries.
    met = [F.when(test[how](F.lit(w)), F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(i).alias("off"), F.lit(need[q]).alias("need"))) for q, i, how, w in pieces]
    if not met:
        return spark.createDataFrame([], f"query_id long, {key} long, start int")
    terms = staged(vocabulary.select("term", "df", F.explode(F.filter(F.array(*met), lambda x: x.isNotNull())).alias("x")).select("term", "df", "x.*"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "off"))
    first = terms.groupBy("query_id", "off").agg(F.sum("df").alias("df")).withColumn("r", rank).where("r = 1").select("query_id", F.col("off").alias("lead"))
    found = index.words.joined(staged(terms.join(first, "query_id").select("term", "query_id", "off", "need", "lead")))
    start = found.where("off = lead").select("query_id", key, "need", F.explode(F.transform("positions", lambda p: p - F.col("off"))).alias("start")).distinct()
    rest = found.where("off <> lead").select("query_id", key, "off", "positions").join(start, ["query_id", key]).where(F.array_contains("positions", F.col("start") + F.col("off")))
    rest = rest.groupBy("query_id", key, "start", "need").agg(F.count_distinct("off").alias("n")).where("n = need - 1")
    return start.where("need = 1").select("query_id", key, "start").unionByName(rest.select("query_id", key, "start"))


def match_phrase(index: TextIndex, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, freq: how often a document has a stated phrase's words side by side; from postings alone."""
    return _at(index, _pieces(queries, True)[0], key).groupBy("query_id", key).agg(F.count_distinct("start").alias("freq"))


def _contained(docs: DataFrame, phrases: list, key: str, text: str) -> DataFrame:
    """query_id, key: containment of some stated phrases, tried in one scan."""
    met = F.filter(F.array(*[F.when(has_phrase(F.col(text), F.lit(r["query"])), F.lit(r["query_id"]).cast("long")) for r in phrases]), lambda q: q.isNotNull())
    return docs.select(key, F.explode(met).alias("query_id")).select("query_id", key)


def phrase_hits(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", index: TextIndex | None = None) -> DataFrame:
    """query_id, key: the documents whose text contains a query, in any case; the queries are a stated set.

    The positions of its words give candidates, whose texts are read to verify; few are read by key, so that other
    row groups are passed over.  A phrase without words is tried on all texts.
    """
    index = build_index(docs, key, text) if index is None else index
    asked = queries.where(F.length(F.trim("query")) > 0)
    pieces, bare = _pieces(asked, False)
    near = staged(_at(index, pieces, key).select("query_id", key).distinct())
    few = near.select(key).distinct().limit(NAMED + 1).collect()
    texts = docs.select(key, text)
    if len(few) <= NAMED:
        texts = texts.where(F.col(key).isin([r[key] for r in few]))
    # The stated phrases are literals: joined with, they would hide that the candidates are few, and all texts be shuffled.
    phrase = [F.when(F.col("query_id") == r["query_id"], F.lit(r["query"])) for r in asked.select("query_id", "query").collect()]
    near = near.withColumn("_q", F.coalesce(*phrase, F.lit(None).cast("string")))
    out = near.join(texts, key).where(has_phrase(F.col(text), F.col("_q"))).select("query_id", key)
    if bare:
        out = out.unionByName(_contained(docs, asked.where(F.col("query_id").isin(bare)).collect(), key, text))
    return out


def relevance(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.1, index: TextIndex | None = None) -> DataFrame:
    """query_id, key, score: the sum of the boosted clauses that match, at least one of them, scores under least off.

    phrase, all terms, most terms and near terms score BM25 times their boost.  With an index that has n-grams, the
    documents that hold all of a query's score their BM25 times a boost; without, containment scores its boost.
    """
    asked = queries.where(F.length(F.trim("query")) > 0)
    index = build_index(docs, key, text) if index is None else index
    base = staged(bm25(docs, asked, key, text, index))
    boost = F.lit(0.0) + F.when(F.col("matched") == F.col("terms"), BOOSTS["all"]).otherwise(0.0)
    boost = boost + F.when(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("terms") * SHARE)), BOOSTS["most"]).otherwise(0.0)
    exact = base.select("query_id", key, (F.col("score") * boost).alias("s"))
    whole = staged(phrase_hits(docs, asked, key, text, index))
    phrase = base.join(whole, ["query_id", key], "left_semi").select("query_id", key, (F.col("score") * BOOSTS["phrase"]).alias("s"))
    if has_ngram_field(index):
        grams = _scored(index.grams, ngram_terms(asked), key).join(staged(ngram_hits(index, asked, key)), ["query_id", key], "left_semi")
        part = grams.select("query_id", key, (F.col("score") * BOOSTS["ngram"]).alias("s"))
    else:
        part = whole.select("query_id", key, F.lit(BOOSTS["wildcard"]).alias("s"))
    words = asked.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    # Each near term counts as the wanted one, less for its edits; the near terms come from the vocabulary.
    wide = staged(words.withColumnRenamed("term", "wanted").join(near_terms(index.vocabulary, words), "wanted").select("query_id", "wanted", "term", "edits"))
    fuzzy = index.words.joined(wide, False).groupBy("query_id", key, "wanted").agg(F.max(1.0 / (1 + F.col("edits"))).alias("s"))
    fuzzy = fuzzy.groupBy("query_id", key).agg((F.sum("s") * BOOSTS["fuzzy"]).alias("s"))
    every = exact.unionByName(phrase).unionByName(part).unionByName(fuzzy)
    return every.groupBy("query_id", key).agg(F.sum("s").alias("score")).where(F.col("score") >= least)


def highlight(text: Column, terms: list[str], fragments: int = 3, size: int = 150) -> Column:
    """Up to three fragments of ``size`` characters around the first terms, each marked; none without a term.

    Terms are looked for in the whole text and fragments laid around them, so that no cut goes through a term or makes
    one of a longer word.  A fragment takes all terms that fit; a term longer than ``size`` is a fragment of its own.
    """
    import re

    rx = "(?iu)\\b(" + "|".join(re.escape(t) for t in terms) + ")\\b"
    whole = F.coalesce(text, F.lit(""))
    hits, gaps = F.regexp_extract_all(whole, F.lit(rx), F.lit(0)), F.split(whole, rx, -1)
    state = lambda done, held, used: F.struct(done.alias("done"), held.alias("held"), used.cast("int").alias("used"))

    def closed(acc: Column, gap: Column) -> Column:
        full = F.concat(acc["held"], F.substring(gap, F.lit(1), F.greatest(F.lit(0), size - acc["used"])))
        return F.when(acc["used"] > 0, F.concat(acc["done"], F.array(full))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        gap, n = F.length(x["gap"]), F.length(x["hit"])
        mark = F.concat(F.lit("<mark>"), x["hit"], F.lit("</mark>"))
        tail = F.when(acc["used"] > 0, F.greatest(F.lit(0), size - acc["used"])).otherwise(0)
        lead = F.greatest(F.lit(0), F.least(gap - tail, ((size - n) / 2).cast("int")))
        more = state(acc["done"], F.concat(acc["held"], x["gap"], mark), acc["used"] + gap + n)
        new = state(closed(acc, x["gap"]), F.concat(F.substring(x["gap"], gap - lead + 1, lead), mark), lead + n)
        fits = (acc["used"] > 0) & (acc["used"] + gap + n <= size)
        return F.when(F.size(acc["done"]) >= fragments, acc).when(fits, more).otherwise(new)

    none = F.array().cast("array<string>")
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    found = F.aggregate(pairs, state(none, F.lit(""), F.lit(0)), step, lambda acc: F.slice(closed(acc, F.element_at(gaps, -1)), 1, fragments))
    return F.when(whole.rlike(rx), found).otherwise(none)
