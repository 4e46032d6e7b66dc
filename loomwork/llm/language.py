"""Document and paragraph languages.

Method, compression classification: each language has a raw-content zstandard dictionary; a text belongs to the language
whose dictionary encodes it smallest, and is rejected (no language) when the runner-up is within a narrow margin. The
dictionaries are fitted on a bounded sample of labelled documents (about SAMPLE_DOCUMENTS, an equal quota a language in order of
a hash of doc_id, at most SAMPLE_CHARS of each; DICTIONARY_CHARS a language), cleaned of wrong labels by classifying one half
with the other half's dictionaries. Every paragraph of every document is then classified whole and at any length by one rule:
its pieces of PIECE characters are encoded each against the dictionary, so that what a text repeats of itself never outweighs
it, and the sizes are added.

Defined results: null or blank text has no paragraphs; paragraphs that are only code or log lines, or hold no word outside code,
have language null and confidence 0, and so have those whose margin is narrow; documents without a classified paragraph have null.
Confidence is 1 - best / runner-up, compared with what the text takes without a dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_CHARS = 2000, 8000, 40_000
#: Narrow margins: the runner-up must take so many more bytes, and so large a share of the best more.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.02
#: Characters that are encoded at once.
PIECE = 400
#: lang_codes is a fixed list; a larger table than this is an error, as every task holds it.
CODES_LIMIT = 5000
#: Settings of the encoder, the same for every language: one quick search per position in a window that holds dictionary and text; fixed values.
ENCODER = {"window_log": 17, "hash_log": 14, "chain_log": 6, "search_log": 1, "min_match": 5, "target_length": 1, "strategy": zstandard.STRATEGY_FAST}

_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)")
_LOG = re.compile(
    r"""(?x)^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b[\]: ]|\d{1,3}(?:\.\d{1,3}){3}\s-\s|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s\d\d:\d\d:\d\d|Traceback\s\(most|\s+at\s[\w.$]+\(|\s+File\s"|level=\w+|ts=\d|\[\s*\d+\.\d+\]|<\d+>)"""
)
#: Most lines of prose start with a letter that no log line starts with.
_LOG_START = re.compile(r"[\s\[\d<lt]|[TDINWEFCJMAOS][A-Za-z]{2}")
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_MARKS = ".,;:!?()[]{}<>\"'*#>-–—«»„“”‘’¿¡…"


def paragraphs(text: str | None) -> list[str]:
    """The pieces of text between blank lines; line ends may be mixed."""
    if not text:
        return []
    flat = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = flat.split("\n")
    lo, hi = 0, len(lines)
    while lo < hi and not lines[lo].strip():
        lo += 1
    while hi > lo and not lines[hi - 1].strip():
        hi -= 1
    return _BLANK.split("\n".join(lines[lo:hi])) if hi > lo else []


def proses(text: str | None) -> list[str]:
    """The prose of each paragraph, in lower case with single spaces; '' where it is only code or log lines."""
    found, fenced = [], False
    for piece in paragraphs(text):
        keep = []
        for line in piece.split("\n"):
            if _FENCE.match(line):
                fenced = not fenced
            elif not (fenced or line.startswith(("    ", "\t")) or _LOG_START.match(line) and _LOG.match(line)):
                keep.append(line)
        body = "\n".join(keep)
        if "`" in body:
            body = _CODE_SPAN.sub(" ", body)
        # words only: paths, identifiers, numbers and addresses say nothing about the language
        prose = " ".join([w for w in [x.strip(_MARKS) for x in body.split()] if w.replace("'", "").replace("’", "").replace("-", "").isalpha()]).lower()
        found.append(prose)
    return found


class Languages:
    """Per-language dictionaries and the decision by size."""

    def __init__(self, content: dict[str, str]):
        self.content = {k: v for k, v in sorted(content.items()) if v}
        self.codes = list(self.content)
        self._size = []
        for code in self.codes:
            raw = zstandard.ZstdCompressionDict(self.content[code].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters(**ENCODER, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw.precompute_compress(compression_params=settings)
            self._size.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=raw).compress)

    def __reduce__(self):
        return Languages, (self.content,)

    def classify(self, prose: str) -> tuple[str | None, float]:
        """(language or None, confidence)."""
        if not prose or len(self.codes) < 2:
            return None, 0.0
        pieces = [prose[i : i + PIECE].encode() for i in range(0, len(prose), PIECE)]
        sizes = [sum([len(f(piece)) for piece in pieces]) for f in self._size]
        best = min(sizes)
        at = sizes.index(best)
        second = min(x for i, x in enumerate(sizes) if i != at)
        if second - best < max(MARGIN_BYTES, MARGIN_SHARE * best):
            return None, 0.0
        return self.codes[at], round(1 - best / second, 4)


def _joined(texts: list[str], limit: int) -> str:
    out, n = [], 0
    for t in texts:
        if n >= limit:
            break
        out.append(t)
        n += len(t) + 1
    return " ".join(out)[:limit]


def fit(rows: list[tuple[str, str]], rounds: int = 3) -> Languages:
    """Dictionaries from (label, text) rows. Rows whose text the other half's dictionaries give to another language are left out."""
    samples = [(lang, p, k % 2) for k, (lang, text) in enumerate(rows) for p in proses(text) if p]
    keep = samples
    for _ in range(rounds):
        halves = []
        for side in (0, 1):
            by: dict[str, list[str]] = {}
            for lang, p, half in keep:
                if half == side:
                    by.setdefault(lang, []).append(p)
            halves.append(Languages({k: _joined(v, DICTIONARY_CHARS) for k, v in by.items()}))
        checked = [(lang, p, half) for lang, p, half in samples if halves[1 - half].classify(p)[0] == lang]
        sound = {x[0] for x in checked}
        # a language of which nothing is confirmed keeps all its samples; the others are cleaned
        keep = checked + [x for x in samples if x[0] not in sound]
    by = {}
    for lang, p, _ in keep:
        by.setdefault(lang, []).append(p)
    return Languages({k: _joined(v, DICTIONARY_CHARS) for k, v in by.items()})


def usable_labels(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """documents with label: the code2 that lang stands for, in any spelling and with or without a region; else null."""
    rows = codes.select("code2", "code3", "english_name").limit(CODES_LIMIT + 1).collect()
    if len(rows) > CODES_LIMIT:
        raise ValueError(f"more than {CODES_LIMIT} languages")
    names = {str(n).strip().lower(): r.code2 for r in rows for n in r if n and r.code2}
    plain = F.lower(F.trim("lang"))
    base = F.regexp_replace(plain, r"^([^\s_-]+)[-_]\s?[^\s].*$", "$1")
    if not names:
        return documents.withColumn("label", F.lit(None).cast("string"))
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return documents.withColumn("label", F.coalesce(F.try_element_at(mapping, plain), F.try_element_at(mapping, base)))


def fitted(labelled: DataFrame) -> Languages:
    """Dictionaries from a sample of labelled documents: of each language the first in order of a hash of their id, as many of each.

    Of a text SAMPLE_CHARS at most are fitted on, so the driver gets SAMPLE_DOCUMENTS x SAMPLE_CHARS characters at any size. The
    hash's range is narrowed by each language's number of documents first, so few rows more leave their tasks."""
    usable = labelled.where("label is not null and text is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return fit([])
    quota = max(4, SAMPLE_DOCUMENTS // len(counts))
    ranges = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, int(min(1.0, 2 * quota / n + 8 / n) * (1 << 40)))])
    near = usable.where(F.col("h") < F.try_element_at(ranges, "label")).select("label", "h", "doc_id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))  # about twice the quota a language
    rows = near.withColumn("place", place).where(F.col("place") <= quota).select("label", "text", "h", "doc_id").collect()
    return fit([(r.label, r.text) for r in sorted(rows, key=lambda r: (r.h, r.doc_id))])


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("label", pa.string()),
        ("para_no", pa.int64()),
        ("lang", pa.string()),
        ("confidence", pa.float64()),
        ("letters", pa.int64())
    ]
)


def paragraph_languages(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, label, para_no, lang, confidence, letters: one row per paragraph. One pass without a shuffle."""
    labelled = usable_labels(documents, codes)
    model = fitted(labelled)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in _SCHEMA]
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, prose in enumerate(proses(text)):
                    lang, sure = model.classify(prose)
                    for c, v in zip(cols, (doc, label, no, lang, sure, len(prose))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)

    return labelled.select("doc_id", "label", "text").where("text is not null").mapInArrow(
        batches, "doc_id long, label string, para_no long, lang string, confidence double, letters long"
    )


def wrong_or_missing(paragraphs_: DataFrame) -> DataFrame:
    """Paragraphs whose language differs from the document's label, or whose document has none."""
    return paragraphs_.where("lang is not null and (label is null or label <> lang)").select("doc_id", "para_no", "lang")


def document_languages(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, label, lang, confidence, languages: per document the language that most letters are in, and how many there are."""
    per = paragraph_languages(documents, codes).groupBy("doc_id", "label", "lang").agg(
        F.sum("letters").alias("letters"), F.try_divide(F.sum(F.col("confidence") * F.col("letters")), F.sum("letters")).alias("confidence")
    )
    best = F.max(F.when(F.col("lang").isNotNull(), F.struct("letters", "lang", "confidence")))
    whole = per.groupBy("doc_id", "label").agg(best.alias("b"), F.sum("letters").alias("all"), F.count("lang").alias("languages"))
    found = whole.select(
        "doc_id",
        "label",
        F.col("b.lang").alias("lang"),
        F.round(F.coalesce(F.try_divide(F.col("b.confidence") * F.col("b.letters"), F.col("all")), F.lit(0.0)), 4).alias("confidence"),
        "languages"
    )
    # documents without a paragraph have a row too
    return usable_labels(documents, codes).select("doc_id", "label").join(found.drop("label"), "doc_id", "left").select(
        "doc_id",
        "label",
        "lang",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("languages", F.lit(0)).cast("long").alias("languages")
    )
