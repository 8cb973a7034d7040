"""Token counts by a SentencePiece BPE model.

The model's text form puts U+2581 before the text and in place of each space. No piece has U+2581 behind another
character, so no merge crosses the point before a run of U+2581: the pre-tokens `U+2581* other*` are encoded apart, and
a text's count is the sum over them. Pieces are counted once for each distinct pre-token of the corpus, and joined to
per-document pre-token frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm.common import bound_batches, documents, stage

MARK = "▁"
#: Slots of the table of frequent pre-tokens whose counts each task holds, pre-tokens of a slot, and bytes of one that may
#: be held; all others go through a shuffle join.
SLOTS, WAYS, HELD_BYTES = 1 << 15, 8, 64
#: Pre-tokens, and their characters, that a task counts before it passes them on.
_HELD, _HELD_CHARS = 400_000, 16 << 20


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless the model's merges stay within pre-tokens."""
    sp = load(model)
    for i in range(sp.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)):
            raise ValueError(f"piece {i} of {model} crosses pre-tokens")


class PreTokens:
    """Splits a normalised text into pre-tokens. Line feeds are cut out where no piece has one."""

    def __init__(self, model: str):
        sp = load(model)
        self.normalise = sp.normalize
        apart = not any("\n" in sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        self.find = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if apart else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        probe = "Ab c\n  déﬁ  x\t y "
        # Most models of this kind only put marks in; then the text form needs no call.
        self.plain = sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK) if self.plain else self.normalise(text)
        return self.find(marked)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row for each row.

    Null text counts as empty, and both have no tokens. Special strings inside texts are ordinary text. Rows that
    repeat an id are counted each. Other columns are not read. An empty table gives an empty result. The path of the
    model must exist on every machine. slots: of the table of held pre-tokens; any number gives the same result.
    """
    check_model(model)
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, chars = PreTokens(model), Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                before = len(held)
                found = split(text)
                held.update(found)
                chars += len(text) * (len(held) - before) // max(1, len(found))  # of the new ones, about
                if len(held) > _HELD or chars > _HELD_CHARS:
                    yield pa.record_batch({"piece": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                    held, chars = Counter(), 0
        if held:
            yield pa.record_batch({"piece": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        # The text form of a pre-token goes in as a plain text: without its first mark, which the model puts back.
        # What doesn't start with a mark is encoded behind a line feed's bytes, whose number is known.
        extra = len(sp.encode("\n"))
        for batch in batches:
            words = batch.column("piece").to_pylist()
            fed = [w[1:].replace(MARK, " ") if w[0] == MARK else "\n" + w for w in words]
            ids = sp.encode(fed, num_threads=1)
            own = [0 if w == MARK else len(i) if w[0] == MARK else len(i) - extra for w, i in zip(words, ids)]
            own = [len(sp.encode("\n" + w)) - extra if w == MARK else n for w, n in zip(words, own)]
            yield pa.record_batch({"piece": batch.column("piece"), "n": batch.column("n"), "tokens": pa.array(own, pa.int32())})

    counted = texts.select("text").mapInArrow(corpus_counts, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = stage(counted.mapInArrow(pieces, "piece string, n long, tokens int"), "pieces")
    # The most frequent pre-tokens of each slot: none that many documents hold goes through the join, unless WAYS more
    # frequent ones have its slot.
    slot = F.pmod(F.xxhash64("piece"), F.lit(slots)).alias("slot")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "piece"))
    top = vocabulary.where(F.octet_length("piece") <= HELD_BYTES).select("piece", "tokens", "n", slot).withColumn("place", place).where(F.col("place") <= WAYS).select("piece", "tokens").toArrow()
    common = spark.sparkContext.broadcast((top.column("piece").combine_chunks(), top.column("tokens").to_numpy()))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = PreTokens(model), dict(zip(common.value[0].to_pylist(), common.value[1].tolist()))
        for batch in batches:
            n_bytes, n_known, rest, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                n_bytes.append(len(text.encode()))
                total, words, freq = 0, [], []
                for word, n in Counter(split(text)).items():
                    tokens = known.get(word)
                    if tokens is None:
                        words.append(word)
                        freq.append(n)
                    else:
                        total += n * tokens
                n_known.append(total)
                rest.append(words)
                times.append(freq)
            yield pa.record_batch({"id": batch.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "known": pa.array(n_known, pa.int64()), "words": pa.array(rest, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int32()))})

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, known long, words array<string>, times array<int>"
    # row: tells repeated ids apart
    per_doc = texts.mapInArrow(frequencies, schema).withColumn("row", F.monotonically_increasing_id())
    base = F.array(F.struct(F.lit(None).cast("string").alias("words"), F.lit(None).cast("int").alias("times")))
    flat = per_doc.select("row", "id", "n_bytes", "known", F.explode(F.when(F.size("words") > 0, F.arrays_zip("words", "times")).otherwise(base)).alias("f")).select("row", "id", "n_bytes", "known", F.col("f.words").alias("piece"), F.col("f.times").alias("times"))
    # Texts without rare pre-tokens take no part in the join; their key is spread.
    flat = flat.withColumn("piece", F.coalesce("piece", F.concat(F.lit("\n\n"), F.col("row").cast("string"))))
    joined = flat.join(vocabulary.select("piece", "tokens"), "piece", "left")
    summed = joined.groupBy("row", "id", "n_bytes", "known").agg(F.coalesce(F.sum(F.col("times") * F.col("tokens")), F.lit(0)).alias("rare"))
    n = (F.col("known") + F.col("rare")).cast("long")
    return summed.select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
