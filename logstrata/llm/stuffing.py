"""Pages of keywords, link lists or product tags instead of sentences.

Every line of every page is cut into words, and all phrases of one and two words (for link lists the words of their addresses too)
are counted over the whole corpus: the distinct hosts that have the phrase, and the pages that have it in list-dense lines, in
sentences, and in their first or last line. Only phrases that several hosts share are kept. A phrase with more pages at their
edges than inside belongs to menus, notices and footers; of the others the log-odds between lists and sentences tell how much a
phrase that is replicated elsewhere speaks for stuffing. All of that is learnt from the corpus itself, in any language and also for
text that was decoded wrongly, as long as it was done so alike.

A line is then judged by the phrases it is stitched from, joined with the evidence of its form: how dense it is in links, tags,
counts, short items and repetitions. Form alone never decides: a line none of whose phrases other hosts share isn't stuffing. A page
is flagged if more than half of its characters, menus, notices, title and footer left aside, lie in such lines.

Plan: one Python pass turns each text into word hashes and line forms, which are written once; counting and judging then work on
whole arrays. Counts are combined per batch before the shuffle, by phrase and host and then by phrase, so a word of all pages has a
row per host. The kept phrases are broadcast while they are at most BROADCAST_PHRASES; beyond that, pages are dealt into groups and
each group gets the phrases that its own pages ask for by a join. Both ways give the same answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, spread

#: Hosts that have to share a phrase before it counts.
LEAST_HOSTS = 3
#: A page is flagged above this part of its characters.
SHARE = 0.5
#: Kept phrases that are broadcast at most, 13 bytes each; more are joined to groups of pages.
BROADCAST_PHRASES = 2_000_000
#: Words of the texts that share one part of the phrases in the join; they bound what a task holds.
GROUP_WORDS = 1_000_000

#: Words of the window in which repetition is measured; distinct part of them at or below which a line repeats itself.
_WINDOW, _REPEATED = 16, 0.6
#: Short lines in a row that make a list, one item each.
_RUN = 5
#: What the form of a line adds to the mean evidence of its phrases, by form, and what the sum has to exceed.
_OTHER, _SENTENCE, _FACT, _LIST, _STRONG = range(5)
_FORM = np.array([-0.75, -0.75, -100.0, 1.25, 2.5])
_BAR = 0.25
#: Replicated phrases that a line without the form of a list has to be stitched from at least.
_STITCHED = 5
#: Pages that are worked on as one set of arrays.
_CHUNK = 1000

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W\d_]+")
# Scripts written without blanks are cut into overlapping pairs of characters.
_DENSE = re.compile("[぀-ヿ㐀-鿿]")
_URL = re.compile(r"(?:https?://|www\.)[^\s)\]]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s)\]]*)?(?=$|[\s)\],;])", re.I)
# lets pass every line without :// that _URL can match
_HOSTLIKE = re.compile(r"[a-z0-9-]\.[a-z]{2}|www\.", re.I)
_SEPARATORS = (*",;|*·•/>»、，｜・", " - ", " – ", " — ", "  ")
_ITEM = re.compile(r"[,;|*·•/>»、，｜・]|\s[-–—]\s|\s{2}")
_TAG = re.compile(r"#\w{2,}")
_END = re.compile(r"[.!?。！？…][\"'”’)»]*$")
_STOP = re.compile(r"[.!?。！？](?=\s|$)|[。！？]")
_CITED = re.compile(r"^\[?\d{1,3}[\].)]\s.*\(\d{4}\)")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[-+]?\d+(?:[.,:]\d+)*")
_CODE = re.compile(r"^[A-Z]{1,3}-?\d{2,}(?:-\w+)?\b")
_COUNT = re.compile(r"\w\s?\(\d+\)|[^\W\d_]{3,}\d{1,3}(?=\s|$)")
# characters that stand between letters where bytes were read in a wrong charset
_ODD = re.compile("[\x80-\xa0\xa2-\xaa\xac-\xaf\xb1-\xb6\xb8-\xba\xbc-\xbeŒœŠšŸŽžƒˆ˜†-•…‰‹›€™�｡-ﾟ縺繧繝]")
_EDGES = ".,;:!?()[]{}\"'�"


def is_damaged(line: str) -> bool:
    """Whether a line reads like bytes of another charset."""
    return len(_ODD.findall(line)) * 12 > len(line)


def _single_bytes() -> dict[int, int | None]:
    """Every character that a one-byte western charset makes of a byte, to that byte as a character; the lost ones to nothing."""
    out: dict[int, int | None] = {0xFFFD: None}
    for byte in range(128, 256):
        try:
            out[ord(bytes([byte]).decode("cp1252"))] = byte
        except UnicodeDecodeError:
            pass
    return out


_BYTES = _single_bytes()


def repaired(line: str) -> str:
    """A damaged line as it was before its UTF-8 was read as a western or Japanese charset, or the line itself if that wasn't so."""
    raw = line.translate(_BYTES).encode("latin-1", "ignore")
    if 2 * len(raw) < len(line):
        raw = line.encode("cp932", "ignore")
    got = raw.decode("utf-8", "ignore")
    return got if 4 * len(got) > len(line) and not got.isascii() and not is_damaged(got) else line


def words_of(text: str) -> list[str]:
    out = _WORD.findall(text.lower())
    if _DENSE.search(text):
        cut = []
        for w in out:
            if len(w) > 2 and _DENSE.search(w):
                cut += [w[i : i + 2] for i in range(len(w) - 1)]
            else:
                cut.append(w)
        return cut
    return out


def distinct_part(words: list[str]) -> float:
    """Distinct words by all words, on average over windows, so that it doesn't fall with the length of a text."""
    n = len(words)
    if n <= 3 * _WINDOW // 2:
        return len(set(words)) / n if n else 1.0
    parts = [len(set(words[i : i + _WINDOW])) for i in range(0, n - _WINDOW + 1, _WINDOW)]
    return sum(parts) / (_WINDOW * len(parts))


def line_form(text: str) -> tuple[int, bool, list[str]]:
    """What a line's form tells: its form, whether it's short enough to be one item of a list, and its words."""
    links = tags = numbers = counted = 0
    damaged = not text.isascii() and is_damaged(text)
    if damaged:
        text = repaired(text)
        damaged = is_damaged(text)
    plain = text
    if "://" in text or "." in text and _HOSTLIKE.search(text):
        plain, links = _URL.subn(" ", text)
    words = [x for w in plain.lower().split() if (x := w.strip(_EDGES)) and not x.isdigit()] if damaged else words_of(plain)
    n = len(words)
    if "#" in text:
        tags = len(_TAG.findall(text))
    digits = _DIGIT.search(plain) is not None
    if digits:
        numbers = len(_NUMBER.findall(plain))
        counted = len(_COUNT.findall(plain)) if numbers > 3 else 0
    dense = _DENSE.search(plain) is not None
    items = 1 + sum(map(plain.count, _SEPARATORS))
    distinct = distinct_part(words)
    cited = links > 0 and _CITED.match(text) is not None
    code = digits and items >= 3 and _CODE.match(text) is not None
    if dense:
        short_items = items >= 5 and len(plain) <= 10 * items and "。" not in plain
    else:
        short_items = items >= 5 and len(plain) <= 28 * items and n <= 3.5 * items
    if short_items:
        short_items = sum(_WORD.search(i) is not None for i in _ITEM.split(plain)) >= 5
    repeated = n >= 8 and distinct <= _REPEATED
    linked = links > 0 and not cited and n <= 7 * links and not (links == 1 and n > 5 and _STOP.search(text))
    ended = _END.search(text) is not None
    short = n <= 6 and len(text) <= 60 and not ended
    if not cited and (tags >= 3 or linked or code or counted >= 4):
        if linked:
            words = words + words_of(" ".join(_URL.findall(text)))
        return _STRONG, False, words
    odd = not links and not tags and not damaged and 3 * sum(map(len, words)) < len(text)
    if not repeated and (cited or odd or (numbers >= 2 and numbers * 3 >= n) or (n <= 3 and text[:1].isdigit())):
        return _FACT, False, words
    if short_items or repeated:
        return _LIST, short, words
    if n >= 5 and distinct > 0.7 and ended:
        return _SENTENCE, False, words
    return _OTHER, short, words


class _Hashes(dict):
    """Word -> 64-bit hash, remembered; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def page_lines(text: str, hashes: _Hashes, seen: dict) -> tuple[list[int], list[int], list[int], list[int]]:
    """(form, characters, end of the words) of each line that isn't blank, and the hashes of all words. Short lines are often the
    same on many pages; ``seen`` remembers them."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text))
    forms: list[int] = []
    chars: list[int] = []
    ends: list[int] = []
    tokens: list[int] = []
    run = 0
    for raw in text.splitlines():
        x = raw.strip()
        if not x:
            continue
        known = seen.get(x)
        if known is None:
            form, short, words = line_form(x)
            known = form, short, [hashes[w] for w in words]
            if len(x) <= 80:
                if len(seen) > 50_000:
                    seen.clear()
                seen[x] = known
        form, short, ids = known
        forms.append(form)
        chars.append(len(x))
        tokens += ids
        ends.append(len(tokens))
        run = run + 1 if short else 0
        if run >= _RUN:
            forms[-1] = _LIST
            if run == _RUN:
                forms[-_RUN:] = [_LIST] * _RUN
    return forms, chars, ends, tokens


_PARSED = "host bigint, forms array<int>, chars array<int>, ends array<int>, tokens array<bigint>"


def parsed(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``documents`` as lines and word hashes: the columns of ``keep`` and _PARSED; empty arrays for null and blank texts."""
    slim = documents.select(*keep, F.xxhash64(F.coalesce("host", F.lit(""))).alias("host"), "text")
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(at, _CHUNK)
                out: list[list] = [[], [], [], []]
                for text in b.column(len(keep) + 1):
                    text = text.as_py()
                    for c, v in zip(out, page_lines(text, hashes, seen) if text else ((), (), (), ())):
                        c.append(v)
                small = [pa.array(c, pa.list_(pa.int32())) for c in out[:3]]
                columns = [*(b.column(i) for i in range(len(keep) + 1)), *small, pa.array(out[3], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "host", "forms", "chars", "ends", "tokens"])

    return spread(slim).mapInArrow(run, f"{kinds}, {_PARSED}")


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number from several, for telling tuples apart."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


@dataclass
class Pages:
    """The lines and phrases of some pages as arrays: ``phrase`` with ``of_line``; lines with ``page``, ``form``, ``chars``."""

    n: int
    page: np.ndarray
    form: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    last: np.ndarray
    phrase: np.ndarray
    of_line: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> Pages:
        forms, chars, ends, tokens = (b.column(b.schema.get_field_index(c)) for c in ("forms", "chars", "ends", "tokens"))
        lines = forms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        page = np.repeat(np.arange(b.num_rows), lines)
        form, length, end = (c.flatten().to_numpy(zero_copy_only=False) for c in (forms, chars, ends))
        word = tokens.flatten().to_numpy(zero_copy_only=False)
        before = np.cumsum(words) - words
        stop = end.astype(np.int64) + before[page]
        line_of_word = np.searchsorted(stop, np.arange(len(word)), side="right")
        same = line_of_word[1:] == line_of_word[:-1] if len(word) else np.zeros(0, bool)
        two = _mix(word[:-1][same], word[1:][same]).view(np.int64) if len(word) else word
        change = np.diff(page) != 0 if len(page) else np.zeros(0, bool)
        edge = np.ones(1 if len(page) else 0, bool)
        return Pages(b.num_rows, page, form, length, np.r_[edge, change], np.r_[change, edge],
                     np.concatenate([word, two]), np.concatenate([line_of_word, line_of_word[1:][same] if len(word) else line_of_word]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _CHUNK):
            yield b.slice(at, _CHUNK)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, host, edge, said, listed): pages of the chunk with the phrase in each kind of place."""
    for b in _chunks(batches):
        p = Pages.of(b)
        several = np.bincount(p.page, minlength=p.n)[p.page] > 2
        place = np.where((p.first | p.last) & several, 0, np.where(p.form == _SENTENCE, 1, np.where(p.form >= _LIST, 2, 3)))
        kind = place[p.of_line]
        used = kind < 3
        phrase, kind, page = p.phrase[used], kind[used], p.page[p.of_line[used]]
        _, one = np.unique(_mix(phrase, page, kind), return_index=True)
        phrase, kind = phrase[one], kind[one]
        host = b.column(b.schema.get_field_index("host")).to_numpy()[page[one]]
        _, at, group = np.unique(_mix(phrase, host), return_index=True, return_inverse=True)
        counts = [np.bincount(group[kind == k], minlength=len(at)).astype(np.int32) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(phrase[at]), pa.array(host[at]), *map(pa.array, counts)], names=["phrase", "host", "edge", "said", "listed"])


def learn_phrases(pages: DataFrame, least_hosts: int = LEAST_HOSTS) -> DataFrame:
    """``(phrase bigint, edge boolean, value float)`` for every phrase of the `parsed` pages that ``least_hosts`` hosts or more share.

    ``edge``: more pages have it in their first or last line than elsewhere. ``value``: the log-odds of its pages between lists and
    sentences, each relative to the phrase that most of them have, within -4 and 4; 0 without either.
    """
    noted = pages.select("host", "forms", "chars", "ends", "tokens").mapInArrow(_count, "phrase bigint, host bigint, edge int, said int, listed int")
    by_host = noted.groupBy("phrase", "host").agg(*[F.sum(c).alias(c) for c in ("edge", "said", "listed")])
    counted = by_host.groupBy("phrase").agg(F.count(F.lit(1)).alias("hosts"), *[F.sum(c).alias(c) for c in ("edge", "said", "listed")])
    counted = materialize(counted.where(F.col("hosts") >= least_hosts), "phrases")
    most = counted.agg(F.coalesce(F.max("said"), F.lit(0)), F.coalesce(F.max("listed"), F.lit(0))).first()
    least = 0.3 / (1 + max(most))
    odds = F.log(F.col("listed") / (most[1] + 1) + least) - F.log(F.col("said") / (most[0] + 1) + least)
    inside = F.col("said") + F.col("listed")
    return counted.where((inside > 0) | (F.col("edge") > 0)).select("phrase", (F.col("edge") > inside).alias("edge"), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), odds)).cast("float").alias("value"))


class Lexicon:
    """Some phrases as sorted arrays."""

    def __init__(self, phrase: np.ndarray, edge: np.ndarray, value: np.ndarray):
        order = np.argsort(phrase, kind="stable")
        self.phrase, self.edge, self.value = phrase[order], edge[order].astype(bool), value[order].astype(np.float32)

    def shares(self, p: Pages) -> np.ndarray:
        """Part of each page's characters in stuffed lines, less those of menus, notices, footers and the title."""
        lines = len(p.page)
        if not lines or not len(self.phrase):
            return np.zeros(p.n)
        at = np.minimum(np.searchsorted(self.phrase, p.phrase), len(self.phrase) - 1)
        hit = self.phrase[at] == p.phrase
        edge = np.bincount(p.of_line[hit], self.edge[at[hit]], lines)
        counts = hit & ~self.edge[at]
        known = np.bincount(p.of_line[counts], minlength=lines)
        value = np.bincount(p.of_line[counts], self.value[at[counts]], lines)
        every = np.bincount(p.of_line, minlength=lines)
        body = ~((edge > 0) & (2 * edge > every))
        # the first line left is the title if it's neither sentence nor list and more follows
        place = np.cumsum(body) - 1
        starts = np.flatnonzero(p.first)
        rank = place - np.repeat(place[starts] - body[starts], np.diff(np.r_[starts, lines])) - 1
        left = np.bincount(p.page[body], minlength=p.n)[p.page]
        body &= ~((rank == 0) & (left > 1) & (p.form == _OTHER))
        stuffed = body & (known >= np.where(p.form >= _LIST, 1, _STITCHED)) & (value / np.maximum(known, 1) + _FORM[p.form] > _BAR)
        total = np.bincount(p.page[body], p.chars[body], p.n)
        return np.bincount(p.page[stuffed], p.chars[stuffed], p.n) / np.maximum(total, 1)


def _by_broadcast(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    table = phrases.toArrow()  # at most BROADCAST_PHRASES rows
    held = pages.sparkSession.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*held.value)
        for b in _chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lexicon.shares(Pages.of(b)))], names=["doc_id", "share"])

    return pages.select("doc_id", "host", "forms", "chars", "ends", "tokens").mapInArrow(run, "doc_id bigint, share double")


def _by_groups(pages: DataFrame, phrases: DataFrame, group_words: int) -> DataFrame:
    """Groups of pages by hash; a group asks for each phrase once per chunk, and its phrases come before its pages."""
    spark = pages.sparkSession
    words = pages.agg(F.sum(F.size("tokens"))).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(1 + words // group_words)).cast("int")
    pages = pages.select(part.alias("part"), "doc_id", "host", "forms", "chars", "ends", "tokens")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            p = Pages.of(b)
            own = b.column(0).to_numpy()[p.page[p.of_line]]
            _, one = np.unique(_mix(p.phrase, own), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[one]), pa.array(p.phrase[one])], names=["part", "phrase"])

    asked = pages.mapInArrow(ask, "part int, phrase bigint").distinct()
    none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns[1:]]
    entries = asked.join(phrases, "phrase").select("part", F.lit(0).alias("role"), "phrase", "edge", "value", *none)
    texts = pages.select("part", F.lit(1).alias("role"), F.lit(None).cast("bigint").alias("phrase"), F.lit(None).cast("boolean").alias("edge"),
                         F.lit(None).cast("float").alias("value"), *pages.columns[1:])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    together = entries.unionByName(texts).repartition(parts, "part").sortWithinPartitions("part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, lexicon = None, [], None
        for b in _chunks(batches):
            part, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            turn = np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(part)]):
                piece = b.slice(lo, hi - lo)
                if part[lo] != at:
                    at, held, lexicon = part[lo], [], None
                if role[lo] == 0:
                    held.append([piece.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)])
                    continue
                if lexicon is None:
                    none = [np.zeros(0, t) for t in (np.int64, bool, np.float32)]
                    lexicon = Lexicon(*(np.concatenate([none[i], *(h[i] for h in held)]) for i in range(3)))
                yield pa.RecordBatch.from_arrays([piece.column(5), pa.array(lexicon.shares(Pages.of(piece)))], names=["doc_id", "share"])

    return together.mapInArrow(run, "doc_id bigint, share double")


def page_shares(pages: DataFrame, phrases: DataFrame, broadcast_phrases: int = BROADCAST_PHRASES, group_words: int = GROUP_WORDS) -> DataFrame:
    """``(doc_id, share)`` of `parsed` pages, judged by ``phrases`` of `learn_phrases`."""
    if phrases.count() <= broadcast_phrases:
        return _by_broadcast(pages, phrases)
    return _by_groups(pages, phrases, group_words)


def stuffed_shares(documents: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """``(doc_id bigint, share double)`` of every row; 0 for null, empty and blank texts. Repeated rows answer each."""
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "host", "text")
    pages = materialize(parsed(slim), "pages")
    return page_shares(pages, learn_phrases(pages) if phrases is None else phrases)


def stuffed_pages(documents: DataFrame, share: float = SHARE, phrases: DataFrame | None = None) -> DataFrame:
    """``(doc_id)`` of the pages with more than ``share`` of their text in keywords, link lists or product tags.

    Learns the phrases from the same documents unless some are given. Mirrors are judged like any page. Lists of plain facts
    (mostly numbers, references), pages without text and pages none of whose phrases other hosts share aren't flagged; a null host
    counts as one host. Rows of one doc_id give one row, a null doc_id is one too.
    """
    return stuffed_shares(documents, phrases).where(F.col("share") > share).select("doc_id").distinct()
