"""Records of evaluation splits that also occur, exactly or nearly, in the training split.

The content of every evaluation question is a passage. Passages are sharded by
document and by the words that a repetition must share. An Aho-Corasick automaton
over a shard's passages, with the spans of each passage as patterns, scans the
training texts that can belong to the shard; the spans it finds are intervals of
the passage, merged into the passage's coverage, and passages that are covered
well enough are checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.questions import Vocabulary, content, document_key, same_content
from lumenloom.session import written

#: Least share of questions with a word for the word to count as known; at most about 20 / FREQUENT words are.
FREQUENT = 0.001
#: Most words in a span of a passage.
SPAN = 3
#: Passages in one automaton, and training texts scanned by one copy of it; shards beyond are divided.
BLOCK, SLICE = 2_000, 20_000
#: Share of a passage's letters that must be covered before it is checked word by word.
LEAST_COVERAGE = 0.5


def vocabulary(rows: DataFrame, question: str = "question", frequent: float = FREQUENT) -> Vocabulary:
    """The words in at least a `frequent` share of all questions, counted over every row.

    The driver gets only those words: with k words a question, at most k / frequent.
    """
    words = F.array_distinct(F.split(F.lower(F.col(question)), "[^a-z]+"))
    counts = rows.where(F.col(question).isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = rows.where(F.col(question).isNotNull()).count()
    kept = counts.where((F.length("word") >= 3) & (F.col("n") >= max(5, frequent * total)))
    return Vocabulary({r.word: r.n for r in kept.select("word", "n").collect()})


def anchors(tokens: Sequence[str], words: Vocabulary) -> list[str]:
    """The keys by which a text is sharded; texts that ask the same share at least one.

    Words that only themselves can match (`Vocabulary.fixed`: names, numbers,
    places) must all be the same in both texts, so together they are one key, and
    a shard holds only texts that differ in known words and slips of them,
    however many texts the document has. A text without such words is sharded by
    each of its known words and each word that it may have a slip of.
    """
    fixed = sorted(t for t in tokens if words.fixed(t))
    if fixed:
        return ["=" + " ".join(fixed)]
    meant = {m for t in tokens for m in (words.meant(t) or words.loose(t) or (t,))}
    return sorted(meant)


def question_texts(rows: DataFrame, words: Vocabulary, train: Sequence[str] = ("train",), evaluation: Sequence[str] = ("val", "test")) -> DataFrame:
    """row_id, split, data_source, is_train, doc, body (content words), anchors, of every row that can be in a pair.

    Rows of other splits, without document, and whose question is null, blank
    or n/a or has no content word are left out.
    """
    picked = rows.where(F.col("split").isin(*train, *evaluation) & F.col("document_id").isNotNull() & F.col("question").isNotNull())
    picked = picked.select("row_id", "split", "data_source", F.col("split").isin(*train).alias("is_train"), "document_id", "question")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: dict[str, str] = {}
        for batch in batches:
            keep, docs, bodies, keys = [], [], [], []
            for i, (d, q) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if len(documents) > 100_000:
                    documents.clear()
                doc = documents.get(d)
                if doc is None:
                    doc = documents[d] = document_key(d)
                tokens = content(q, words) if doc else []
                if tokens:
                    keep.append(i)
                    docs.append(doc)
                    bodies.append(" ".join(tokens))
                    keys.append(anchors(tokens, words))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), kept.column(2), kept.column(3), pa.array(docs, pa.string()), pa.array(bodies, pa.string()), pa.array(keys, pa.list_(pa.string()))],
                ["row_id", "split", "data_source", "is_train", "doc", "body", "anchors"],
            )

    return picked.mapInArrow(run, "row_id bigint, split string, data_source string, is_train boolean, doc string, body string, anchors array<string>").withColumn("text_id", F.xxhash64("doc", "body"))


def merged(intervals: list[tuple[int, int]]) -> int:
    """The total length of intervals (start, end), overlaps counted once."""
    covered, reach = 0, -1
    for start, end in sorted(intervals):
        if end > reach:
            covered += end - max(start, reach)
            reach = end
    return covered


class Shard:
    """The automaton over the passages of one shard: finds what of them a text repeats."""

    def __init__(self) -> None:
        self.passages: list[tuple[int, list[str]]] = []
        self.spans: dict[str, list[tuple[int, int, int]]] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, text_id: int, tokens: list[str]) -> None:
        """Adds an evaluation passage; its spans of up to SPAN words are patterns, each with its interval in the passage."""
        at = len(self.passages)
        self.passages.append((text_id, tokens))
        ends = [0]
        for token in tokens:
            ends.append(ends[-1] + len(token))
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + SPAN) + 1):
                self.spans.setdefault(" ".join(tokens[i:j]), []).append((at, ends[i], ends[j]))

    def covered(self, tokens: Sequence[str], least: float) -> Iterator[tuple[int, float]]:
        """Passages of which the text repeats at least the share `least`, with the share.

        Every span that the automaton finds in the text is an interval of the
        passages that hold it; a passage's intervals are merged, and their length
        over the passage's letters is its coverage.
        """
        if not self.spans:  # by chance no passage fell into this block
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for span in self.spans:
                self.automaton.add_word(f" {span} ", span)
            self.automaton.make_automaton()
        found = {span for _, span in self.automaton.iter(f" {' '.join(tokens)} ")}
        intervals: dict[int, list[tuple[int, int]]] = {}
        for span in found:
            for at, start, end in self.spans[span]:
                intervals.setdefault(at, []).append((start, end))
        for at, parts in intervals.items():
            share = merged(parts) / sum(map(len, self.passages[at][1]))
            if share >= least:
                yield at, share


def scan(texts: DataFrame, words: Vocabulary, least_coverage: float = LEAST_COVERAGE, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """eval_id, train_id, coverage of every evaluation text and training text that ask the same of the same document.

    `texts` holds distinct (text_id, is_train, doc, body, anchors). A shard is a
    (document, anchor); its passages are divided into blocks and its training
    texts into slices of bounded size, every slice meeting every block, so a hot
    document or name is spread over tasks and nothing is dropped.
    """
    keyed = texts.select("text_id", "is_train", "doc", "body", F.explode("anchors").alias("anchor"))
    sizes = (
        keyed.groupBy("doc", "anchor")
        .agg(F.count(F.when(~F.col("is_train"), 1)).alias("n_eval"), F.count(F.when(F.col("is_train"), 1)).alias("n_train"))
        .where("n_eval > 0 and n_train > 0")
        .select("doc", "anchor", F.ceil(F.col("n_eval") / block).alias("blocks"), F.ceil(F.col("n_train") / slice_).alias("slices"))
    )
    spread = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = lambda n: F.array(F.pmod(F.col("text_id"), n))
    placed = (
        keyed.join(sizes, ["doc", "anchor"])
        .withColumn("block", F.explode(F.when(F.col("is_train"), spread(F.col("blocks"))).otherwise(own(F.col("blocks")))))
        .withColumn("slice", F.explode(F.when(F.col("is_train"), own(F.col("slices"))).otherwise(spread(F.col("slices")))))
        .select(F.xxhash64("doc", "anchor", "block", "slice").alias("shard"), "is_train", "text_id", "body")
        .repartition("shard")
        .sortWithinPartitions("shard", "is_train")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, Shard()
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for key, is_train, text_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    current, shard = key, Shard()
                tokens = body.split(" ")
                if not is_train:
                    shard.add(text_id, tokens)
                    continue
                for at, share in shard.covered(tokens, least_coverage):
                    if same_content(shard.passages[at][1], tokens, words):
                        out.append((shard.passages[at][0], text_id, share))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["eval_id", "train_id", "coverage"])

    found = placed.mapInArrow(run, "eval_id bigint, train_id bigint, coverage double")
    return found.groupBy("eval_id", "train_id").agg(F.max("coverage").alias("coverage"))


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the id of their normalised text, written once, and the links between distinct texts."""
    words = vocabulary(rows)
    texts = written(question_texts(rows, words))
    distinct = texts.dropDuplicates(["text_id", "is_train"]).select("text_id", "is_train", "doc", "body", "anchors")
    return texts, scan(distinct, words)


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """row_a, row_b (row_a < row_b): each pair of rows, one of a training and one of an evaluation split, that ask the same.

    Rows delivered again count as rows. Rows whose document is null, or whose
    question is null, blank or n/a, are in no pair. Repeated texts are scanned
    once and expanded only here, by equi-joins on the text's id. An empty table
    gives no pair; extra columns are ignored.
    """
    texts, links = _prepared(rows)
    side = lambda train, name, row: texts.where(F.col("is_train") == train).select(F.col("text_id").alias(name), F.col("row_id").alias(row))
    pairs = links.join(side(False, "eval_id", "e"), "eval_id").join(side(True, "train_id", "t"), "train_id")
    return pairs.select(F.least("e", "t").alias("row_a"), F.greatest("e", "t").alias("row_b"))


def overlap_report(rows: DataFrame) -> DataFrame:
    """Per split and source of the evaluation rows: all rows, those that occur in training, and the pairs.

    Pairs are counted from the number of rows of each text, without expanding them.
    """
    texts, links = _prepared(rows)
    train = texts.where("is_train").groupBy(F.col("text_id").alias("train_id")).agg(F.count(F.lit(1)).alias("copies"))
    hits = links.join(train, "train_id").groupBy(F.col("eval_id").alias("text_id")).agg(F.sum("copies").alias("pairs"))
    found = texts.where("not is_train").join(hits, "text_id").groupBy("split", "data_source").agg(F.count(F.lit(1)).alias("n_found"), F.sum("pairs").alias("n_pairs"))
    total = rows.where(F.col("split").isin("val", "test")).groupBy("split", "data_source").agg(F.count(F.lit(1)).alias("n_rows"))
    same = total["split"].eqNullSafe(found["split"]) & total["data_source"].eqNullSafe(found["data_source"])
    return total.join(found, same, "left").select(
        total["split"], total["data_source"], "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs")
    )


def evaluation_coverage(rows: DataFrame) -> DataFrame:
    """One row per evaluation row that occurs in training: row_id, split, data_source, coverage, n_texts (linked training texts)."""
    texts, links = _prepared(rows)
    best = links.groupBy(F.col("eval_id").alias("text_id")).agg(F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_texts"))
    return texts.where("not is_train").join(best, "text_id").select("row_id", "split", "data_source", "coverage", "n_texts")
