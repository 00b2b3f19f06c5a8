"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their ends and case.  Numbers, units after a number, and names
(capitalised words inside a sentence) become typed placeholders, their values are slots.
Every window of `width` canonical words is a template; a question that was
re-parameterised keeps its templates and changes its slots.  Names are a guess, and text
in capitals has none, so each text is also read in a second view in which names stay
words, in a third in which every word stays itself, and in a fourth in which capitalised
words that begin a text, line or sentence are names, too; windows of all views count.

Templates of documents are joined with those of benchmark items by hash.  Before the
shuffle a bitmap of the items' templates of at most 8 MB drops most windows (it never drops
a match).  Matches are grouped by (document, item), wherever in the document they are; those
windows count that are consistent, so that each item value stands for one document value of
its type (two item values may get the same one).  Where windows contradict each other, the
consistent ones that cover most words are kept; a window without the slot in question
never goes.  A document is contaminated by an item when consistent matches cover at least
`min_cover` of the item's words.

Numbers are digits or number words of four languages; number words that follow each other
("twenty five"), or a digit ("2 million"), are one number.  An item of fewer than
`MIN_WORDS` words is too little for templates: it is matched as it is, as the whole sequence
of its words with their punctuation, whatever the case; one of a single word is matched
with texts that are this word and nothing else.

Defined results
* null or empty documents and items match nothing; items shorter than `width` are one
  template of their own length.
* equal items (ties) are all reported.  Repeated rows get equal results; rows of one id
  are told apart by a hash of their text.  Null ids are reported as null.
* empty tables give empty results; extra columns pass through `decontaminate` untouched,
  whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, column, cut, in_bitmap, private
from quillon.llm.textkit import BYTE, U, list_column, mix64, plain, row_of, span_hashes, words

WIDTH, MIN_WORDS, MIN_COVER = 8, 5, 0.5
#: A template of a view with placeholders must have at least this share of literal words, else it is no evidence.
MIN_LITERAL = 0.5
#: Steps of the search for the largest consistent set.  Past them every window counts that does not contradict itself.
MAX_STEPS = 2000

#: Words that are units when they follow a number, in English, German, French and Spanish.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles "
    "mg g kg t lb lbs oz gram grams kilogram kilograms kilo kilos tonne tonnes ton tons pound pounds ounce ounces "
    "ml cl l litre litres liter liters gallon gallons cup cups pint pints "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres "
    "dollar dollars cent cents euro euros eur usd gbp yen percent degrees degree mph kmh kph w kw kwh v hz khz mhz ghz kb mb gb tb "
    "gramm kilogramm tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "gramme grammes kilogramme kilogrammes mètre mètres kilomètre kilomètres seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés "
    "gramo gramos kilogramo kilogramos tonelada toneladas litro litros metro metros kilómetro kilómetros segundo segundos minuto minutos hora horas día días semana mes meses año años grado grados"
).split()
#: Number words of the same languages.  Words that are articles, units or commoner as something else are left out.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones"
).split()


def _compounds() -> list[str]:
    """Number words that are made of others: twenty-five, fünfundzwanzig, vingt-cinq."""
    english, german, french = NUMBER_WORDS[1:10], ["ein", *NUMBER_WORDS[33:41]], ["un", *"deux trois quatre cinq six sept huit neuf".split()]
    out = [f"{t}-{u}" for t in NUMBER_WORDS[20:28] for u in english]
    out += [f"{u}und{t}" for t in "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split() for u in german]
    out += [f"{t}-{u}" for t in "vingt trente quarante cinquante soixante".split() for u in french]
    return [*out, "quatre-vingts", "quatre-vingt"]


_CORE = np.ones(256, bool)  # bytes of which the inside of a word is made; all but ASCII punctuation
_CORE[[b for b in range(128) if not chr(b).isalnum()]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/+-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
NUM, UNIT, NAME = U(0x4E554D), U(0x554E4954), U(0x4E414D45)


def _hashes(some: list[str]) -> np.ndarray:
    raw = [w.encode() for w in some]
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return np.sort(span_hashes(BYTE[np.frombuffer(b" ".join(raw), np.uint8)], ends - [len(w) for w in raw], ends))


_UNITS, _NUMBERS = _hashes(UNITS), _hashes([*NUMBER_WORDS, *_compounds()])


def _upper_start(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character at each byte is an upper-case letter (Latin, Greek or Cyrillic)."""
    x, y = b[at], b[np.minimum(at + 1, len(b) - 1)]
    return ((x >= 0x41) & (x <= 0x5A)) | ((x == 0xC3) & (y >= 0x80) & (y <= 0x9E) & (y != 0x97)) | ((x == 0xCE) & (y >= 0x91) & (y <= 0xA9)) | ((x == 0xD0) & (y >= 0x90) & (y <= 0xAF))


class Canonical:
    """Canonical words of some rows: per word its row, its kind (0 literal) in the typed view, and its own hash."""

    def __init__(self, raw, low):
        b, s, e = low.data, low.start, low.end
        core = _CORE[b]
        at = np.arange(len(b))
        ahead = np.minimum.accumulate(np.where(core, at, len(b))[::-1])[::-1] if len(b) else at
        back = np.maximum.accumulate(np.where(core, at, -1)) if len(b) else at
        has = np.add.reduceat(core, s) > 0 if len(s) else np.zeros(0, bool)
        if len(s):  # reduceat runs on to the next word's start; separators in between are no core bytes
            has = (np.cumsum(core)[e - 1] - np.where(s > 0, np.cumsum(core)[s - 1], 0)) > 0
        keep = np.flatnonzero(has)
        s2, e2 = ahead[s[keep]], back[e[keep] - 1] + 1
        row = row_of(low.first)[keep]
        value = span_hashes(BYTE[b], s2, e2)
        total = lambda m: np.concatenate([[0], np.cumsum(m[b])])
        digits, numeric = total(_DIGIT), total(_NUMERIC)
        spoken = np.isin(value, _NUMBERS)
        number = spoken | ((digits[e2] > digits[s2]) & ((numeric[e2] - numeric[s2] == e2 - s2) | _DIGIT[b[s2]] if len(s2) else np.zeros(0, bool)))
        # Case and sentence ends are read off the text as it came.
        rb, rs, re_ = raw.data, raw.start[keep], raw.end[keep]
        stops = _STOP[rb[re_ - 1]] | (rb[re_ - 1] == ord(",")) if len(keep) else np.zeros(0, bool)
        joins = np.zeros(len(keep), bool)  # number words that go on with the number before them
        joins[1:] = spoken[1:] & number[:-1] & ~stops[:-1] & (row[1:] == row[:-1])
        at = np.flatnonzero(~joins)
        last = np.append(at[1:], len(keep))[: len(at)]
        self.row = row[at]
        self.value = np.where(last > at + 1, span_hashes(value, at, last), value[at]) if len(at) else value
        number, rs, re_ = number[at], rs[at], re_[last - 1]
        keep = at
        unit = np.zeros(len(keep), bool)
        unit[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        unit &= ~number & np.isin(self.value, _UNITS)
        begin = np.ones(len(keep), bool)
        if len(keep):
            newline = np.concatenate([[0], np.cumsum(rb == 0x0A)])
            begin[1:] = _STOP[rb[re_[:-1] - 1]] | (newline[rs[1:]] > newline[re_[:-1]]) | (self.row[1:] != self.row[:-1])
            first = rs + np.where(_CORE[rb[rs]], 0, 1)
            first = np.minimum(first, re_ - 1)
            wide = np.where(rb[first] >= 0xC0, 2, 1)
            nxt = np.minimum(first + wide, len(rb) - 1)
            shout = (first + wide < re_) & _upper_start(rb, nxt)
            opened = _upper_start(rb, first) & ~shout & ~number & ~unit
        else:
            opened = np.zeros(0, bool)
        self.typed = np.where(number, NUM, np.where(unit, UNIT, U(0)))
        self.named = np.where(opened & ~begin, NAME, self.typed)
        self.views = (np.zeros(len(keep), U), self.typed, self.named, np.where(opened, NAME, self.typed))
        self.first = np.searchsorted(self.row, np.arange(len(low.first)))

    def templates(self, width: int, view: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of one view that no view before it has; view 0 keeps all words."""
        if len(self.row) < width:
            return np.zeros(0, np.int64), np.zeros(0, U)
        ok = self.row[: len(self.row) - width + 1] == self.row[width - 1 :]
        kind = self.views[view]
        if view:
            within = lambda m: (t := np.concatenate([[0], np.cumsum(m)]))[width:] - t[:-width]
            ok &= (within(kind > 0) <= width * (1 - MIN_LITERAL)) & (within(kind != self.views[view - 1]) > 0)
        at = np.flatnonzero(ok)
        return at, span_hashes(np.where(kind > 0, mix64(kind), self.value), at, at + width)


_ROWS = "rid long, th long, pos int, width int, hash long, words array<long>, keys array<long>, n_words int"
_RAW = U(0x524157)  # marks the hashes of items that are matched as they are


def _template_rows(batch: pa.RecordBatch, rows: np.ndarray, pos: np.ndarray, width: int, h: np.ndarray, values: np.ndarray, keys: np.ndarray, n_words: np.ndarray) -> pa.RecordBatch:
    take, size_of = pa.array(rows), np.full(len(rows), width)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("rid").take(take),
            batch.column("th").take(take),
            pa.array(pos.astype(np.int32)),
            pa.array(np.full(len(rows), width, np.int32)),
            pa.array(h.view(np.int64)),
            list_column(values.ravel().view(np.int64), size_of, pa.int64()),
            list_column(keys.ravel().view(np.int64), size_of, pa.int64()),
            pa.array(n_words.astype(np.int32)),
        ],
        names=["rid", "th", "pos", "width", "hash", "words", "keys", "n_words"],
    )


def _windows(widths: list[int], whole: int | None, bits: np.ndarray | None, raw_widths: list[int] | None = None):
    """mapInArrow function from (rid, th, text) to template rows.

    With `whole` (benchmark items) an item's width is min(whole, its words) and all rows
    come; else windows of all `widths` come, if the bitmap has them, and of `raw_widths` words
    as they are.  `words` are the values of a window's words, `keys` name the slots among
    them by type and value, 0 is none; a name that a view keeps as a word has its key, too,
    for it stands for itself there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column("text"))
            low = pc.utf8_lower(text)
            for a, b in _pairs(text, low):
                c = Canonical(a, b)
                size = np.diff(c.first)
                for width in widths:
                    for view in range(len(c.views)):
                        at, h = c.templates(width, view)
                        row = c.row[at]
                        good = size[row] >= MIN_WORDS
                        good &= np.minimum(size[row], whole) == width if whole else in_bitmap(bits, h)
                        at, h, row = at[good], h[good], row[good]
                        if not len(at):
                            continue
                        near = at[:, None] + np.arange(width)
                        slot = c.views[-1][near]
                        keys = np.where(slot > 0, mix64(c.value[near] ^ slot), U(0))
                        yield _template_rows(batch, row + a.rows.start, at - c.first[row], width, h, c.value[near], keys, size[row])
                # Items of few words, as they are.
                plain_size, row_all = np.diff(b.first), row_of(b.first)
                short = (size < MIN_WORDS) & (plain_size > 0)
                own = np.unique(np.minimum(plain_size[short], whole)).tolist() if whole else raw_widths or []
                for width in own:
                    if len(b.hashes) < width:
                        continue
                    at = np.flatnonzero(row_all[: len(b.hashes) - width + 1] == row_all[width - 1 :])
                    row = row_all[at]
                    good = short[row] & (np.minimum(plain_size[row], whole) == width) if whole else plain_size[row] == 1 if width == 1 else np.ones(len(at), bool)
                    at, row = at[good], row[good]
                    h = mix64(span_hashes(b.hashes, at, at + width) ^ _RAW)
                    good = np.ones(len(at), bool) if whole else in_bitmap(bits, h)
                    at, row, h = at[good], row[good], h[good]
                    if len(at):
                        near = at[:, None] + np.arange(width)
                        yield _template_rows(batch, row + a.rows.start, at - b.first[row], width, h, b.hashes[near], np.zeros(near.shape, U), plain_size[row])

    return run


def _pairs(text: pa.Array, low: pa.Array):
    """Words of the same rows before and after lower-casing; row by row where their sizes part the chunks differently."""
    a, b = words(text, lower=False, chunk=1 << 19), words(low, lower=False, chunk=1 << 19)
    for x, y in zip(a, b):
        if x.rows != y.rows:
            break
        yield x, y
    else:
        return
    from dataclasses import replace

    for r in range(min(x.rows.start, y.rows.start), len(text)):
        p, q = next(words(text.slice(r, 1), lower=False)), next(words(low.slice(r, 1), lower=False))
        yield replace(p, rows=range(r, r + 1)), q


def _consistent(windows):
    """Indices of the windows (at, width, pairs of key i and value d) that give each item value one document value and cover most words.

    Branch and bound over the values in conflict; of equal sets the first by a fixed order.  None stays None.
    """
    if windows is None:
        return None
    live, values, words_of, same = [], {}, {}, {(p["i"], p["d"]) for w in windows for p in w["pairs"] if p["same"]}
    for j in sorted(range(len(windows)), key=lambda j: (windows[j]["at"], windows[j]["width"], [tuple(p) for p in windows[j]["pairs"]])):
        m: dict[int, int] = {}
        if all(m.setdefault(p["i"], p["d"]) == p["d"] for p in windows[j]["pairs"]):
            live.append(j)
            values[j], words_of[j] = m, ((1 << windows[j]["width"]) - 1) << windows[j]["at"]
    best, kept, steps, stack = -1, live, 0, [live]
    while stack:
        some = stack.pop()
        cover, options = 0, {}
        for j in some:
            cover |= words_of[j]
            for i, d in values[j].items():
                at = options.setdefault(i, {})
                at[d] = at.get(d, 0) | words_of[j]
        if cover.bit_count() <= best:
            continue
        steps += 1
        if steps > MAX_STEPS:
            return live
        split = [i for i, at in options.items() if len(at) > 1]
        if not split:
            best, kept = cover.bit_count(), some
            continue
        i = max(split, key=lambda i: (sum(m.bit_count() for m in options[i].values()), i))
        for d in sorted(options[i], key=lambda d: (options[i][d].bit_count(), (i, d) in same, d)):  # the most promising is popped first
            stack.append([j for j in some if values[j].get(i, d) == d])
    return kept


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(column(id_col).cast("long").alias("rid"), F.xxhash64(column(text_col)).alias("th"), F.coalesce(column(text_col), F.lit("")).alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, min_cover: float = MIN_COVER) -> DataFrame:
    """(id, th, item, cover, n_slots, reparameterised) for each document and item that contaminates it."""
    items = _keyed(benchmark, item_col, item_text)
    templates = cut(items.mapInArrow(_windows(list(range(MIN_WORDS, width + 1)), width, None), _ROWS).distinct())
    # Widths are at most `width`, so these lists are short.
    widths = sorted(r[0] for r in templates.where(F.col("width") >= MIN_WORDS).select("width").distinct().collect())
    tops = items.mapInArrow(_windows([], width, None), _ROWS)
    raw_widths = sorted(r[0] for r in tops.select("width").distinct().collect())
    bits = bitmap(templates, "hash")
    hits = _keyed(docs, id_col, text_col).mapInArrow(_windows(widths, None, bits, raw_widths), _ROWS)
    ours = templates.select("hash", "width", F.col("rid").alias("item"), F.col("th").alias("item_th"), F.col("pos").alias("at"), F.col("words").alias("item_values"), "keys", F.col("n_words").alias("item_words"))
    both = hits.select("rid", "th", "hash", "width", "words").join(ours, ["hash", "width"])
    zipped = F.filter(F.arrays_zip(F.col("keys").alias("i"), F.col("words").alias("d"), F.col("item_values").alias("v")), lambda p: p["i"] != 0)
    pairs = F.transform(zipped, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), (p["d"] == p["v"]).alias("same")))
    # Windows with the same place in the item and the same slots are one, however often a document holds them.
    lines = both.groupBy("rid", "th", "item", "item_th", "item_words").agg(F.collect_set(F.struct("at", "width", pairs.alias("pairs"))).alias("windows"))
    pairs_of = lambda: F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"])))
    clash = F.size(pairs_of()) > F.size(F.array_distinct(F.transform(pairs_of(), lambda p: p["i"])))
    kept = lines.withColumn("keep", F.udf(_consistent, "array<int>")(F.when(clash, F.col("windows"))))
    kept = kept.withColumn("windows", F.when(F.col("keep").isNull(), F.col("windows")).otherwise(F.transform("keep", lambda j: F.get("windows", j))))
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["at"], w["at"] + w["width"] - 1))))
    out = kept.select("rid", "th", "item", (F.size(covered) / F.col("item_words")).alias("cover"), F.size(pairs_of()).cast("long").alias("n_slots"), F.exists(pairs_of(), lambda p: ~p["same"]).alias("reparameterised"))
    return out.where(F.col("cover") >= min_cover).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, unchanged."""
    rid, th, own = private(docs, "rid", "th", "own")
    bad = matches(docs, benchmark, id_col, text_col, **options).select(F.col("rid").alias(rid), F.col("th").alias(th)).distinct()
    rows = docs.withColumn(own, F.xxhash64(column(text_col)))
    return rows.join(bad, column(id_col).cast("long").eqNullSafe(F.col(rid)) & (F.col(own) == F.col(th)), "left_anti").drop(own)
