"""Personal information inside free text.

Method, bootstrapped contextual extraction: each task finds candidate spans and the lexical patterns they stand in: up to three
words to the left, two to the right, and of the item itself its shape, given or family name, or the words of a street. Seed
entities start a graph of patterns and instances: addresses with an at sign, numbers with a country code, social security numbers
and identity codes of a fixed form, streets of the most usual types, and names whose given name is in the lexicon and is no
ordinary word. Spark scores the graph in turns: a pattern is as good as the share of believed instances it holds, an instance as
sure as its patterns together. What is reported is what patterns that score high hold - a seed has no way past them, and
captions, street types, number formats and names that no list holds come in by the company they keep. Of overlapping spans
those stay that are surest together.

Defined results: null, blank or unreadable text has nothing; repeated rows count each under their own id; the same item
found twice in one part is one row; without seeds or candidates the result is empty. Texts are read whole, and no rule looks at a
fixed number of characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.spans import Spans, heaviest
from loomwork.sources.rawjson import Located, message_parts, opened_located, parse_located
from loomwork.sources.stage import staged

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
ROUNDS, SURE, LIKELY, PRIOR, UNKNOWN, TOGETHER = 3, 0.7, 0.5, 0.5, 0.35, 3
#: More given names than one task should hold are never broadcast; see person_seeds.
LEXICON_LIMIT = 200_000

_TLD_NOT = frozenset("png jpg jpeg gif svg webp ico py js ts go rs rb java sh sql md yaml yml json toml txt css html xml lock".split())
EMAIL = re.compile(
    r"""(?x) (?<![\w.+%@/'-])[\w.+%'-]*[\w+]\s?(?:@|\s?[(\[]\s?(?:at|AT|At)\s?[)\]]\s?|\s(?:AT|at)\s(?=[\w-]+(?:\s(?:DOT|dot)\s|\s?[(\[](?:dot|DOT)[)\]])))
    \s?[\w-]+(?:(?:\.|\s(?:DOT|dot)\s|\s?[(\[]\s?(?:dot|DOT|Dot)\s?[)\]]\s?)[\w-]+)+ """
)
#: What may be a telephone or identity number.
DIGITS = re.compile(
    r"(?<![\w@#/=.,:+(-])(?:[+(]\s?)?\d[\d ().\-/]{5,}\d[A-Z]?(?![\w@])|(?<=[=:])(?:[+(]\s?)?\d[\d ().\-/]{5,}\d(?![\w@])"
    r"|(?<![\w-])[A-Z]{1,2}\d{6,8}[A-Z]?(?![\w-])|(?<![\w-])\d{7,8}-?[A-Z](?![\w-])"
)
_SEPARATED = r"(?:[ .\-/]?\d{2,9})"
#: Forms of seeds: a country's code, or an area in brackets; three, two and four digits, or eight and a letter.
_PHONE_SEED = re.compile(rf"\+\d{{8,15}}|\+\d{{1,3}}[ .\-/]?(?:\(0\)\s?)?\(?\d{{1,4}}\)?{_SEPARATED}{{1,5}}|\(\d{{2,5}}\)\s?\d{{3,4}}[ .\-]\d{{3,5}}")
_ID_SEED = re.compile(r"\d{3}-\d{2}-\d{4}|\d{8}-?[A-Z]")
#: Words of a caption that make a number behind them a seed; captions in other words and languages are learned.
_CAPTION_SEEDS = frozenset("ssn social security passport tax tax_id identity personal".split())
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĻĽŁŃŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_WORD = rf"[{_U}][\w'’-]*"
_EN_TYPES = "Street|St\\.?|Avenue|Ave\\.?|Road|Rd\\.?|Lane|Ln\\.?|Drive|Dr\\.?|Court|Ct\\.?|Crescent|Cres\\.?|Close|Boulevard|Blvd\\.?|Way|Place|Terrace|Square|Row|Walk|Grove|Gardens|Parade|Mews|Quay|Highway|Parkway|Alley|Path|Rise|Hill|Circle|Loop"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Appt\.?|Wohnung|Room|Studio|Ste\.?|Piso|App\.?)\s?(?:\d+(?:\s?[A-Za-z])?|[A-Z])\b"
ADDRESS = re.compile(
    rf"""(?x) (?:{_FLAT.replace(' ', chr(92) + ' ')},?\s)?(?<![\w.,-])\d{{1,5}}[A-Za-z]?,?\s(?:{_WORD}\s){{1,3}}(?:{_EN_TYPES})(?![\w])(?:,?\s{_FLAT.replace(' ', chr(92) + ' ')})?
    | (?<![\w.,-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-z](?=[,\s])))?,?\s(?:rue|avenue|boulevard|impasse|place|allée|chemin|quai|cours|route|passage|square|sentier|ruelle|faubourg|villa|cité)\s(?:(?:de\sla|de\sl['’]|du|des|de|d['’]|aux|au|à\sla)\s?)?{_WORD}(?:\s(?:{_WORD}|de|du|des|la|le|les)(?=\s|[,.;!?]|$)){{0,3}}(?:,\s(?:appt\.?|appartement|apt\.?|bât\.?)\s\w+)?
    | (?<![\w-]){_WORD[:-len("[\\w'’-]*")]}[\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|steig|markt|chaussee|pfad|hof|stieg|straat|laan|plein|gracht|kade|dijk|singel|steeg)\s\d{{1,4}}(?:\s?[a-z])?(?![\w-])(?:,\s{_FLAT.replace(' ', chr(92) + ' ')})?
    | (?<![\w-])(?:Am|An\sder|An\sden|Auf\sdem|Auf\sder|Im|In\sder|In\sden|Zum|Zur|Unter\sden|Hinter\sder|Bei\sder|Vor\sdem|Hinterm)\s(?:[a-zäöüß]+\s)?{_WORD}(?:\s{_WORD})?\s\d{{1,4}}(?:\s?[a-z])?(?![\w-])
    | (?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Rua|Travessa|Praça|Largo|Estrada|Via|Viale|Corso|Piazza|Vicolo|Lungo\w+|ul\.|al\.|ulica|aleja|plac|ул\.|улица|проспект|переулок|rue|avenue|boulevard)\s(?:(?:de\slas?|de\slos|del|de|das?|dos?|della|delle|dei|degli|di|la|las|los|el)\s)*[\w'’-]+(?:\s(?:de|la|del|di|da|do|{_WORD})){{0,4}},?\s(?:n\.?[º°]?\s?|д\.\s?)?\d{{1,4}}(?:\s?[a-z])?(?![\w-])(?:,?\s(?:piso\s\w+|\d+[ºª°](?:\s[A-Z])?|kv\.\s?\d+|кв\.\s?\d+|m\.\s?\d+|{_FLAT.replace(' ', chr(92) + ' ')}))? """
)
_PART = r"(?:(?:van|von|der|den|de|la|di|da|del|dos|du|ter|ten|le|el|bin|al|zu|VAN|VON|DER|DEN|DE|LA|DI|DA|DEL|Van|Von|De|Der)\s)*"
_INI = rf"[{_U}]\."
#: Runs of capitalised words that may hold a name.
RUN = re.compile(rf"(?<![\w.@/'’#-])(?:{_WORD}\.?)(?:,?\s{_PART}{_WORD}\.?)+")
_NAME = re.compile(rf"(?:(?P<fam>{_PART}{_WORD}),\s(?:{_WORD}|{_INI})(?:\s{_INI})?|(?:{_WORD}|{_INI})(?:\s{_INI})?\s{_PART}{_WORD})(?![\w.@/]*[\w@/])")
_LISTED = re.compile(rf"{_PART}{_WORD},\s(?:{_WORD}|{_INI})(?:\s{_INI})?")
_CAMEL = re.compile(rf"[a-zß-ÿ][{_U}]")
#: Street types that make an address a seed, by its first or last word or the end of that; the other types are learned.
_STREET_SEED = re.compile(r"(?i)street|road|avenue|lane|rue|calle|avenida|\w*(?:straße|strasse|weg)")
#: Looser forms of an address: any capitalised or compound word where the type stands.
LOOSE_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]?[ ](?:{_WORD}[ ]){{1,3}}{_WORD}(?![\w.])|(?<![\w-])[{_U}][a-zäöüßéèàç]{{5,}}[ ]\d{{1,4}}(?:\s?[a-z])?(?![\w.:/-])"
)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BREAK = re.compile(r"[.!?;:…]['\"»”)]*\s|\n")

#: Abbreviations do not end a sentence.
_SHORT = re.compile(r"[A-Z]\w{0,3}|no|nr|tel|n|dr|mr|mrs|ms|sr")


class Context:
    """The words around the spans of a text; the text is cut into words once."""

    def __init__(self, text: str):
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [t[0] for t in tokens], [t[1] for t in tokens]
        self.words = ["#" if t[2][0].isdigit() else t[2].lower() for t in tokens]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.breaks = []
        for m in _BREAK.finditer(text):
            mark = text[m.start()]
            k = bisect_left(self.ends, m.start())
            short = mark == "." and k < len(tokens) and self.ends[k] == m.start() and _SHORT.fullmatch(tokens[k][2])
            if mark != ":" and not short:
                self.breaks.append(m.end())

    def left(self, a: int, n: int) -> list[str]:
        """Up to n words before a in its sentence; '^' is the sentence's edge."""
        k = bisect_right(self.breaks, a)
        cut = bisect_left(self.starts, self.breaks[k - 1] if k else 0)
        to = bisect_right(self.ends, a)
        found = self.words[max(cut, to - n) : to]
        return found if len(found) == n else ["^", *found]

    def right(self, b: int, n: int) -> list[str]:
        """Up to n words behind b on its line; '$' is the line's end."""
        at = bisect_left(self.starts, b)
        k = bisect_left(self.lines, b)
        stop = bisect_left(self.starts, self.lines[k]) if k < len(self.lines) else len(self.starts)
        return self.words[at : min(stop, at + n)] or ["$"]

    def patterns(self, a: int, b: int) -> list[str]:
        """The lexical patterns around a span; one without a word says nothing."""
        three, right = self.left(a, 3), self.right(b, 2)
        left, last = self.left(a, 2), self.left(a, 1)[-1]
        marks = [f"{' '.join(left)}|", f"|{' '.join(right)}"]
        if len(three) == 3 and three != left:
            marks.append(f"{' '.join(three)}|")
        if last[0].isalnum() or right[0][0].isalnum():
            marks.append(f"{last}|{right[0]}")
        return [m for m in marks if re.search(r"[^\W\d_]", m)]


def _clean_name(span: str) -> bool:
    return not any(_CAMEL.search(w) and not re.match(rf"(?:Mc|Mac|O['’]|D['’]|De|La|Le|Van|Fitz)[{_U}]", w) or re.search(r"[\d_]", w) for w in span.split())


def person_candidates(text: str, sure: frozenset[str], ordinary: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """(kind, start, end, seed, slot, own patterns); sub-spans of one run of capitalised words share a slot.

    ordinary: given names that are words of the language too; as a pattern they say nothing."""
    for run in RUN.finditer(text):
        slot, listed = run.start(), "," in run.group()
        starts = [run.start()] + [run.start() + m.end() for m in re.finditer(r"\s", run.group())]
        for s in starts:
            m = _NAME.match(text, s, run.end())
            if not m:
                continue
            ends = {m.end()}
            if m.lastgroup != "fam" and listed and (n := _LISTED.match(text, s, run.end())):
                ends.add(n.end())
            for e in ends:
                span = text[s:e].rstrip(".") if not re.search(rf"\b[{_U}]\.$", text[s:e]) else text[s:e]
                e = s + len(span)
                if not _clean_name(span) or span.count("'") > 2:
                    continue
                words = re.findall(r"[\w'’-]+", span)
                given = words[-1] if "," in span else words[0]
                given = next((w for w in (words[1:] if "," in span else words) if len(w) > 1 and w[0].isupper()), given) if "," in span else given
                family = re.findall(r"[\w'’-]+", span.split(",")[0])[-1]
                own = [f"=given {given.lower()}"] if len(given) > 1 and given.lower() not in ordinary else []
                yield "person_name", s, e, 1 if given.lower() in sure else 0, slot, [*own, f"=family {family.lower()}"]


def _shape(span: str) -> str:
    """Digits as #, capitals as A, other letters as a; what separates them stays."""
    return re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "#", span))


def _street(span: str) -> list[str]:
    """Patterns of an address: its first and last words, and the end of a compound."""
    body = re.sub(rf"(?i)^(?:{_FLAT}),?\s|,?\s{_FLAT}$", "", span)
    words = re.findall(r"[^\W\d_][\w'’-]*", body)
    words = [w for w in words if len(w) > 1 and w.lower() not in ("bis", "ter", "quater")]
    if not words:
        return []
    return [f"=first {words[0].lower()}", f"=last {words[-1].lower()}", f"=end {words[-1].lower()[-4:]}"]


def candidates(text: str, sure: frozenset[str], ordinary: frozenset[str] = frozenset()) -> list[tuple]:
    """(kind, start, end, seed, slot, own patterns) of every span that may be personal information."""
    out: list[tuple] = []
    taken = Spans()
    if "@" in text or " at" in text or "at)" in text or "AT" in text or "at]" in text:
        for m in EMAIL.finditer(text):
            last = [w for w in re.split(r"[^\w-]+", m.group()) if w][-1]
            after = text[m.end() : m.end() + 2]
            if last.lower() in _TLD_NOT or not re.fullmatch(r"[^\W\d_]{2,}", last) or (after[:1] == ":" and after[1:].strip()) or after[:1] == "/":
                continue
            a = m.start() + len(m.group()) - len(m.group().lstrip("'"))
            taken.add(a, m.end())
            span = text[a : m.end()]
            domain = re.split(r"(?i)@|\bat\b", span)[-1]
            said = re.sub(r"[\w+%'-]+(?:\.[\w+%'-]+)*", lambda w: w[0].lower() if w[0].lower() in ("at", "dot") else "w", span)
            out.append(("email", a, m.end(), 1 if "@" in span else 0, a, [f"=shape {said}", f"=domain {' '.join(re.findall(r'[^\W_]+', domain)).lower()}"]))
    if re.search(r"\d", text):
        numbers = Spans()
        for m in DIGITS.finditer(text):
            numbers.add(*m.span())
        for form in (ADDRESS, LOOSE_ADDRESS):
            for m in form.finditer(text):
                own = _street(m.group())
                if own and taken.free(*m.span()) and (form is ADDRESS or numbers.free(*m.span())):
                    named = {own[0].split(" ", 1)[1], own[1].split(" ", 1)[1]}
                    if form is ADDRESS:
                        taken.add(*m.span())
                    out.append(("street_address", m.start(), m.end(), 1 if form is ADDRESS and any(_STREET_SEED.fullmatch(w) for w in named) else 0, m.start(), own))
        for m in DIGITS.finditer(text):
            a, b = m.span()
            span = m.group()
            if not taken.free(a, b) or span.count("(") != span.count(")"):
                continue
            digits, shape = sum(c.isdigit() for c in span), [f"=shape {_shape(span)}"]
            out.append(("id_number", a, b, 1 if _ID_SEED.fullmatch(span) else 0, a, shape))
            if 8 <= digits <= 15 and not re.search(r"[^\W\d_]", span):
                out.append(("phone", a, b, 1 if _PHONE_SEED.fullmatch(span) else 0, a, shape))
    out.extend(c for c in person_candidates(text, sure, ordinary) if taken.free(c[1], c[2]))
    return out


_SPANS = pa.schema(
    [
        ("row_table", pa.string()),
        ("row_id", pa.int64()),
        ("part_no", pa.int64()),
        ("slot", pa.int64()),
        ("start", pa.int64()),
        ("kind", pa.string()),
        ("found_text", pa.string()),
        ("seed", pa.int64()),
        ("patterns", pa.list_(pa.string()))
    ]
)
_SPANS_DDL = "row_table string, row_id long, part_no long, slot long, start long, kind string, found_text string, seed long, patterns array<string>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_SPANS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPANS.types)], schema=_SPANS)


def _spans_of(table: str, row: int, part: int, text: str, sure: frozenset[str], ordinary: frozenset[str]) -> Iterator[tuple]:
    found = candidates(text, sure, ordinary)
    around = Context(text) if found else None
    for kind, a, b, seed, slot, own in found:
        if kind == "id_number" and not _CAPTION_SEEDS.isdisjoint(around.left(a, 3)):
            seed = 1
        yield table, row, part, slot, a, kind, text[a:b], seed, own + around.patterns(a, b)


def texts_of_parts(message: str | None) -> list[tuple[int, str]]:
    """(part_no, text) of the text and thinking parts of a raw message."""
    found = []
    for no, part in message_parts(message):
        kind = part.get("type")
        if kind in ("text", "thinking") and isinstance(part.get(kind), str):
            found.append((no, part[kind]))
    return found


def given_names(lexicon: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Given names in lower case: those that are no ordinary words, and those that are. The lexicon's size is checked: beyond
    LEXICON_LIMIT it is an error, as every task holds it."""
    word = F.coalesce("also_a_word", F.lit(False)).alias("word")
    rows = lexicon.where("given_name is not null").select(F.lower("given_name").alias("n"), word).distinct().limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError(f"more than {LEXICON_LIMIT} given names")
    ordinary = frozenset(r.n for r in rows if r.word)
    return frozenset(r.n for r in rows) - ordinary, ordinary


def spans(log_entries: DataFrame, messages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every candidate span with its patterns; no shuffle."""
    names = given_names(lexicon)

    def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([x for entry, message in rows for no, text in texts_of_parts(message) for x in _spans_of("log_entries", entry, no, text, *names)])

    def says(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([x for row, text in rows if text for x in _spans_of("messages", row, 0, text, *names)])

    raw = log_entries.where("message is not null").select("entry_id", "message").mapInArrow(log, _SPANS_DDL)
    return raw.unionByName(messages.where("text is not null").select("message_id", "text").mapInArrow(says, _SPANS_DDL))


def _together(scores: Column) -> Column:
    """How sure the best TOGETHER of a few scores make it."""
    best = F.slice(F.sort_array(scores, asc=False), 1, TOGETHER)
    return 1 - F.aggregate(best, F.lit(1.0), lambda left, x: left * (1 - F.least(x, F.lit(0.999))))


def beliefs(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """profile, belief of the pattern-instance graph after the given number of turns. found: kind, found_text, seed, patterns, profile.

    Spans of one kind, instance and set of patterns are one profile with a count; counts combine before each shuffle, so what a
    third of all spans share costs one row a task. A pattern's score is the share of its spans whose instance is believed, where
    an unknown one counts UNKNOWN only; a profile is as sure as its best patterns together, an instance the mean of its profiles,
    and believed from LIKELY on; seeds stay at 1 inside the graph, but belief is what the patterns say."""
    grouped = found.groupBy("profile").agg(
        F.first("kind").alias("kind"), F.first(
            F.lower("found_text")
        ).alias("instance"), F.first("patterns").alias("patterns"), F.max("seed").cast("double").alias("seed"), F.count("*").alias("n")
    )
    held = staged(grouped)
    edges = staged(held.select("profile", "kind", "n", F.explode("patterns").alias("pattern")))
    named = held.select("profile", "kind", "instance", "seed", "n")
    seeds = named.groupBy("kind", "instance").agg(F.max("seed").alias("belief"))
    belief = named.join(seeds, ["kind", "instance"]).select("profile", "belief")
    for turn in range(rounds):
        weight = F.col("belief") + UNKNOWN * (1 - F.col("belief"))
        scores = edges.join(belief, "profile").groupBy("kind", "pattern").agg(
            (F.sum(F.col("belief") * F.col("n")) / (F.sum(weight * F.col("n")) + PRIOR)).alias("score")
        ).where("score > 0")
        said = edges.join(scores, ["kind", "pattern"]).groupBy("profile").agg(_together(F.collect_list("score")).alias("said"))
        if turn < rounds - 1:
            per = named.join(said, "profile", "left").groupBy("kind", "instance").agg(
                (F.sum(F.col("n") * F.coalesce("said", F.lit(0.0))) / F.sum("n")).alias("mean"), F.max("seed").alias("seed")
            )
            likely = per.select("kind", "instance", F.greatest("seed", F.when(F.col("mean") >= LIKELY, F.col("mean")).otherwise(0.0)).alias("belief"))
            belief = staged(named.join(likely, ["kind", "instance"]).select("profile", "belief"))
    return said.select("profile", F.col("said").alias("belief"))


def personal_information(log_entries: DataFrame, messages: DataFrame, lexicon: DataFrame, rounds: int = ROUNDS, withhold: float = 0.0) -> DataFrame:
    """row_table, row_id, part_no, start, kind, found_text, seed of every item found.

    withhold: the share of seed instances, by a hash of their text, that the graph is not told of; for measuring what patterns find."""
    all_spans = spans(log_entries, messages, lexicon)
    if withhold:
        hidden = F.pmod(F.xxhash64("kind", F.lower("found_text")), F.lit(1000)) < int(withhold * 1000)
        all_spans = all_spans.withColumn("seed", F.when(hidden, F.lit(0).cast("long")).otherwise(F.col("seed")))
    profile = F.md5(F.concat_ws("\u001f", "kind", F.lower("found_text"), F.array_join("patterns", "\u001e")))
    found = staged(all_spans.withColumn("profile", profile))
    sure = beliefs(found, rounds).where(F.col("belief") >= SURE)
    scored = found.drop("patterns").join(sure, "profile").withColumn("rank", F.col("seed") * 0.5 + F.col("belief"))
    slots = scored.groupBy("row_table", "row_id", "part_no", "slot").agg(F.collect_list(F.struct("start", "kind", "found_text", "seed", "rank")).alias("spans"))
    return slots.select("row_table", "row_id", "part_no", "spans").mapInArrow(_disjoint, _ITEMS_DDL)


_ITEMS = pa.schema([_SPANS.field(c) for c in ("row_table", "row_id", "part_no", "start", "kind", "found_text", "seed")])
_ITEMS_DDL = "row_table string, row_id long, part_no long, start long, kind string, found_text string, seed long"


def surest(spans: list[dict]) -> list[dict]:
    """The spans (start, found_text, seed, rank) of a slot that are kept: disjoint, with most seeds, then the highest ranks, then most text, then the last start."""
    if len(spans) < 2:
        return spans
    spans = sorted(spans, key=lambda x: (x["kind"], x["start"], x["found_text"]), reverse=True)
    places = [(x["start"], x["start"] + len(x["found_text"])) for x in spans]
    return [spans[i] for i in heaviest(places, [(x["seed"], x["rank"], b - a, a) for x, (a, b) in zip(spans, places)])]


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (table, row, part, x["start"], x["kind"], x["found_text"], x["seed"]) for table,
            row,
            part,
            spans in zip(*(c.to_pylist() for c in batch.columns)) for x in surest(spans)
        ]
        cols = list(zip(*rows)) if rows else [[]] * len(_ITEMS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ITEMS.types)], schema=_ITEMS)


def _placeholders(text: str, found: list[dict]) -> list[tuple[int, int, str]]:
    """(start, end, placeholder) of the items of a text, without overlap."""
    spans, pos = [], 0
    for m in sorted(found, key=lambda m: (m["start"], -len(m["found_text"]))):
        end = m["start"] + len(m["found_text"])
        if m["start"] >= pos and end <= len(text):
            spans.append((m["start"], end, f"[{m['kind'].upper()}]"))
            pos = end
    return spans


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for a, b, new in spans:
        out += [text[pos:a], new]
        pos = b
    return "".join(out) + text[pos:]


def mask_text(text: str | None, found: list[dict] | None) -> str | None:
    """text with its items (start, kind, found_text) replaced by typed placeholders such as [EMAIL]; all else stays."""
    return _replaced(text, _placeholders(text, found)) if text and found else text


def mask_message(message: str | None, found: list[dict] | None) -> str | None:
    """A raw message with the items (part_no, start, kind, found_text) of its parts replaced; every other character of the raw text stays."""
    value = opened_located(parse_located(message)) if message and found else None
    content = value.get("content") if isinstance(value, dict) else None
    parts = {0: content} if isinstance(content, str) else {
        i: p.get(p.get("type")) for i, p in enumerate(content) if isinstance(p, dict)
    } if isinstance(content, list) else {}
    spans = []
    for no, text in parts.items():
        if isinstance(text, Located):
            spans += [(text.raw(a), text.raw(b), new) for a, b, new in _placeholders(text, [m for m in found if m["part_no"] == no])]
    return _replaced(message, sorted(spans)) if spans else message


def masked(df: DataFrame, id_column: str, text_column: str, items: DataFrame, how: Callable[[str | None, list[dict] | None], str | None] = mask_text) -> DataFrame:
    """df with the items (row_id, part_no, start, kind, found_text) of each row replaced by typed placeholders; how: mask_text or mask_message.

    Offsets count characters as Python does. A row without items, or with null text, stays as it is. The rows are joined with
    their items, which is one shuffle of the texts; a row's items are as many as its text has room for."""
    marks = items.groupBy("row_id").agg(F.collect_list(F.struct("part_no", "start", "kind", "found_text")).alias("_marks"))
    joined = df.join(marks.withColumnRenamed("row_id", id_column), id_column, "left").select(*df.columns, "_marks")
    at, schema = df.columns.index(text_column), df.schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = list(batch.columns[:-1])
            cols[at] = pa.array([how(t, found) for t, found in zip(cols[at].to_pylist(), batch.columns[-1].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return joined.mapInArrow(batches, schema)
