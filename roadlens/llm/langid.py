"""Language identification by compression.

For each learned language a raw-content Zstandard dictionary is made of sampled labelled text. A text is cut
into blocks, every block is compressed with every dictionary, and the language with the fewest bytes over the
whole text wins. A text whose best two languages lie close together is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import BROADCAST_ROWS, by_position, ship, with_text_columns, write_out

UNKNOWN = "und"
#: Distinct labelled texts sampled for each language, and letters that a language's dictionary has at most: of the
#: sampled texts, in the order of their hashes, as many whole ones as fit, and at least one.
SAMPLE_ROWS = 400
DICTIONARY_LETTERS = 800_000
#: A block is compressed apart, so that the dictionary and not the text's own past decides.
BLOCK_BYTES = 4096
LEVEL = 6
#: What isn't a letter tells nothing of a language, and neither does case.
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Relative margin between the best two languages under which a text is rejected.
MARGIN = 0.004

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def normal(text: str) -> str:
    return " " + NOT_LETTERS.sub(" ", text.lower())


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, letters: int = DICTIONARY_LETTERS) -> dict[str, bytes]:
    """The dictionaries' contents from (text, lang): ``rows`` distinct texts a language, the first by the text's
    hash, or all where it has fewer, in ``letters`` code points.

    Texts are normalised and gathered on executors, and each language's content leaves them whole, so the driver
    gets one content a language. Languages come by their number of labelled rows, the largest first. Rows with a
    null language or without text are ignored; no such rows, no languages. The hash is a property of the text, so
    the sample does not depend on partitioning, and copies of a text count once.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    # Hashes alone are shuffled, each text's once a task.
    hashes = usable.groupBy("lang", "h").agg(F.count("*").alias("n"))
    sizes = write_out(hashes.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "languages")
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    wanted = sizes.select(F.col("lang").alias("w_lang"), "n", "texts", F.least(F.lit(1.0), F.lit(1.2 * rows + 100.0) / F.col("texts")).alias("share"))
    fields = T.StructType([T.StructField("rank", T.LongType()), T.StructField("content", T.BinaryType())])

    def gather(key: tuple, found: pa.Table) -> pa.Table:
        texts = sorted(zip((found.column("h").to_numpy() % (1 << 30)).tolist(), found.column("h").to_pylist(), found.column("text").to_pylist(), strict=True))
        out, size, before = [], 0, None
        for _, h, text in texts:
            if h == before or len(out) >= rows:
                continue
            before, piece = h, normal(text)
            if out and size + len(piece) > letters:
                continue
            out.append(piece)
            size += len(piece)
        # The last bytes of a dictionary are the nearest ones; shuffled by hash no source dominates an end.
        return pa.table({"lang": pa.array([key[0].as_py()]), "rank": pa.array([found.column("n")[0].as_py()]), "content": pa.array(["".join(out).encode()], pa.binary())})

    contents: dict[str, tuple[int, bytes]] = {}
    ship(labelled.sparkSession)
    while True:
        # A share of each language's texts that holds ``rows`` of them all but surely; whole small languages.
        joined = usable.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col("lang") == F.col("w_lang")).filter((F.col("share") >= 1) | (place < F.col("share")))
        taken = joined.groupBy("lang", "h").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("texts").alias("texts"), F.first("share").alias("share"))
        taken = write_out(taken, "language-samples")
        for r in taken.select("lang", "h", "text", "n").groupBy("lang").applyInArrow(gather, T.StructType([T.StructField("lang", T.StringType()), *fields.fields])).collect():
            contents[r["lang"]] = (r["rank"], bytes(r["content"]))
        # Should chance have left too few of a language, more of it is read.
        got = taken.groupBy("lang").agg(F.count("*").alias("got")).withColumnRenamed("lang", "g_lang")
        short = wanted.join(got, F.col("w_lang") == F.col("g_lang"), "left").filter((F.col("share") < 1) & (F.coalesce("got", F.lit(0)) < F.least(F.lit(rows), F.col("texts"))))
        short = write_out(short.select("w_lang", "n", "texts", F.least(F.lit(1.0), 4 * F.col("share")).alias("share")), "languages")
        if short.isEmpty():
            break
        wanted = short
    return {lang: content for lang, (_, content) in sorted(contents.items(), key=lambda item: (-item[1][0], item[0]))}


class Classifier:
    """Compressors by language, in the order learned (the language with the most rows first), which breaks ties."""

    def __init__(self, contents: dict[str, bytes], margin: float) -> None:
        self.margin = margin
        self.langs = list(contents)
        self.compressors = []
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))
        self.frame = len(self.compressors[0].compress(b"")) if self.compressors else 0

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) - self.frame * len(blocks) for c in self.compressors]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(normal(text).encode())
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.langs[best], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(second, 1)
        return self.langs[best], min(1.0, 0.5 + 5 * margin), margin, margin < self.margin

    def __call__(self, texts: list) -> list[list]:
        found = [self.classify(t) for t in texts]
        return [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in FIELDS]


def identify(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if no language
    was learned. Ties go to the language learned from more rows, with margin 0, and are rejected. With one language
    nothing is close. Every row gives a row; whole texts are read; clashing columns are replaced.
    """
    packed = {lang: zlib.compress(data) for lang, data in contents.items()}

    def make() -> Callable[[list], list[list]]:
        return Classifier({lang: zlib.decompress(z) for lang, z in packed.items()}, margin)

    return with_text_columns(docs, text_col, FIELDS, make)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with the columns of ``docs``; learned from those of them that aren't held out.

    Null, empty and letterless texts are rejected and go, and so does every document if none has a language. Repeated
    rows are judged alike; no column can clash; an empty table gives an empty one.
    """
    renamed, back, place = by_position(docs)
    return back(identify(renamed, learn(training_rows(docs)), text_col=place("text")).filter(~F.col("rejected")))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns, and margin and rejected; nulls, empty and long texts, ties and repeated rows as in
    ``identify``. A null doc_id is not held out, and teaches nothing."""
    found = identify(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
