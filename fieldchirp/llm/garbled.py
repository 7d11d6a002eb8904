"""Problem 10: text decoded with a wrong character encoding."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldchirp.scratch import materialize

# Encodings that texts were wrongly read in, and those they were meant in.
LEGACY = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "iso8859_15", "cp1254", "cp1253", "iso8859_5", "mac_cyrillic", "iso8859_7")
INTENDED = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "euc_jp", "shift_jis", "cp1250", "iso8859_5", "mac_cyrillic", "gb18030", "euc_kr", "big5")
LAYERS = 4
ESCAPES = 16  # times that a text may have been escaped
MARGIN = 6.0  # bits that the garbling cost must drop by
STRICT_MARGIN = 3.0  # the same where the intended encoding is UTF-8, which text of another encoding seldom satisfies
SURER = 1.0  # bits that the cost per feature must drop by for a single-byte or double-byte encoding
STRICT_CHARS = 3  # multi-byte characters of a strict UTF-8 round trip that prove a garbling whatever the corpus holds
RARE = 9.0  # a feature rarer than one in 2**9 makes a segment worth trying against single-byte encodings


class Legacy:
    """Re-encodes text under a legacy encoding; bytes it leaves undefined stand for their control characters."""

    def __init__(self, name: str) -> None:
        chars = []
        for b in range(128, 256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        # what the encoding doesn't hold must fail, so it is sent beyond latin-1
        self.table = {c: 0xFFFF for c in range(128, 256)} | {ord(c): 128 + i for i, c in enumerate(chars)}
        cls = lambda lo, hi: "[" + re.escape("".join(chars[lo - 128 : hi - 127])) + "]"
        cont = cls(0x80, 0xBF)
        one = f"(?:{cls(0xF0, 0xF4)}{cont}{{3}}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xC2, 0xDF)}{cont})"
        self.one, self.utf8 = re.compile(one), re.compile(f"{one}+")

    def encode(self, text: str) -> bytes | None:
        try:
            return text.translate(self.table).encode("latin-1")
        except UnicodeEncodeError:
            return None

    def from_utf8(self, text: str, made: set[str] | None = None) -> str:
        """Undo UTF-8 read in this encoding, wherever in the text it stands; ``made`` collects the characters won."""

        def fix(m: re.Match) -> str:
            raw = self.encode(m[0])
            try:
                won = m[0] if raw is None else raw.decode("utf-8")
            except UnicodeDecodeError:
                return m[0]
            if made is not None:
                made.update(won)
            return won

        return self.utf8.sub(fix, text)

    def is_whole(self, text: str) -> bool:
        """Whether the text is strict UTF-8 from end to end when re-encoded."""
        raw = self.encode(text)
        try:
            return raw is not None and bool(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return False

    def is_utf8(self, text: str) -> bool:
        """Whether all that isn't ASCII in the text is UTF-8 read in this encoding, beyond chance: every byte takes part, and enough characters aren't mere typesetting."""
        raw = self.encode(text)
        try:
            if raw is None or not all(unicodedata.category(c)[0] in "LMNPSZ" for c in raw.decode("utf-8") if c > "\x7f"):
                return False
        except UnicodeDecodeError:
            return False
        held = [m[0] for m in self.one.finditer(text) if not TYPOGRAPHIC.issuperset(m[0][1:])]
        return len(held) >= STRICT_CHARS and len(set(held)) > 1


@lru_cache(1)
def _legacies() -> dict[str, Legacy]:
    return {n: Legacy(n) for n in LEGACY}


@lru_cache(1)
def _any_utf8() -> re.Pattern:
    """Matches wherever any of the legacies might hold UTF-8: one pass instead of sixteen."""
    lead = "".join({chr(k) for x in _legacies().values() for k, v in x.table.items() if 0xC2 <= v <= 0xF4})
    cont = "".join({chr(k) for x in _legacies().values() for k, v in x.table.items() if 0x80 <= v <= 0xBF})
    return re.compile(f"[{re.escape(lead)}][{re.escape(cont)}]")


@lru_cache(20_000)
def _kind(c: str) -> str:
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
    return "e" if c.islower() else "E" if c.isupper() else "l" if c.isalpha() else "s"


_RUN = re.compile(r"[^\x00-\x7f]+")
_AROUND = re.compile(r"(?s).{0,2}[^\x00-\x7f]+.{0,2}")
# What typesetting puts between words; free-standing, it says nothing of a wrong encoding.
TYPOGRAPHIC = frozenset("\u00a0\u00ab\u00bb\u00bf\u00a1\u00ad\ufeff" + "".join(map(chr, range(0x2000, 0x2070))))


def _run_features(before: str, run: str, after: str) -> list[tuple[str, str]]:
    out = []
    for c in run:
        out.append((before, c))
        before = _kind(c)
    if after:
        out.append((before, after))
    return out


def _runs(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind before, run of non-ASCII characters, kind after)."""
    n = len(text)
    for m in _RUN.finditer(text):
        i, j = m.span()
        yield _kind(text[i - 1]) if i else " ", m[0], _kind(text[j]) if j < n else ""


def features(text: str) -> list[tuple[str, str]]:
    """(kind of the character before, character), where either isn't ASCII."""
    return [f for r in _runs(text) for f in _run_features(*r)]


# ---- the fixed cost: what no corpus can talk away

# How often the letters of Russian occur, in 10,000.
RUSSIAN = dict(
    о=1097, е=845, а=801, и=735, н=670, т=626, с=547, р=473, в=454, л=440, к=349, м=321, д=298, п=281, у=262, я=201, ы=190, ь=174, г=170, з=165, б=159, ч=144, й=121,
    х=97, ж=94, ш=73, ю=64, ц=48, щ=36, э=32, ф=26, ъ=4, ё=4,
)
HARD = 12.0  # bits of hard evidence that decide without the corpus
SOFT_UTF8 = 4.0  # bits of the fixed cost that UTF-8 must save to be taken without the corpus
EXOTIC = 12.0  # fixed cost of a letter of a script that hardly anybody writes
_PLAIN = frozenset("×·°")  # stand between letters in sound text
_MARKS = frozenset("†‡‰‱")
_QUOTES = frozenset("«»¿¡“”„")
_WITHIN = _PLAIN | frozenset("‘’\u00ad\u200b\u200c\u200d‐‑‒–—―")
_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "HIRAGANA": "J", "KATAKANA": "J", "KATAKANA-HIRAGANA": "J", "CJK": "J", "HANGUL": "K", "HALFWIDTH": "J", "FULLWIDTH": "J"}
_WRITTEN = frozenset("ARABIC HEBREW THAI DEVANAGARI BENGALI TAMIL ARMENIAN GEORGIAN".split())


def _common_ideograph(c: str) -> bool:
    """In the first level of the Japanese or Chinese standard, which holds the characters of daily use."""
    for name, last in (("euc_jp", 0xCF), ("gb2312", 0xD7)):
        try:
            if c.encode(name)[0] <= last:
                return True
        except UnicodeEncodeError:
            pass
    return False


@lru_cache(100_000)
def _form(c: str) -> tuple[str, str, float]:
    """(script or kind, case, fixed cost in bits) of a character."""
    case = "l" if c.islower() else "u" if c.isupper() else ""
    if c.isascii():
        return ("L", case, 0.0) if c.isalpha() else (" ", "", 0.0)
    cat, point = unicodedata.category(c), ord(c)
    if c in _PLAIN or (c in TYPOGRAPHIC and c not in _MARKS) or cat[0] == "Z" or 0x3000 <= point < 0x3040 or 0xFF00 <= point < 0xFF66:
        return "T", "", 1.0
    if cat in ("Cc", "Co", "Cn", "Cs"):
        return "X", "", 10.0
    if cat[0] == "M":
        return "M", "", 3.0
    if cat[0] != "L":
        return ("B", "", 4.0) if 0x2500 <= point < 0x25A0 else ("S", "", 3.0 if point < 0x100 else 5.0)
    first = unicodedata.name(c, "").split(" ")[0]
    script = _SCRIPTS.get(first)
    if script is None:
        return ("S", "", 2.0) if first in ("MICRO", "FEMININE", "MASCULINE", "SUPERSCRIPT", "MODIFIER") else ("O", case, 3.0 if first in _WRITTEN else EXOTIC)
    if script == "C":
        n = RUSSIAN.get(c.lower())
        bits = math.log2(1097 / n) if n else 4.0 if point < 0x460 else 6.0
    else:
        bits = {"L": 2.0 if point < 0x100 else 3.0 if point < 0x180 else 5.0, "G": 2.0, "J": 7.0 if first == "HALFWIDTH" else 2.0, "K": 5.0}[script]
        if first == "CJK":
            bits = 5.0 if _common_ideograph(c) else 9.0
    return script, case, bits


_CONTEXT = re.compile(r"(?s)([\x00-\x7f]{0,2})([^\x00-\x7f]+)(?=(.{0,2}))")


@lru_cache(200_000)
def _run_shape(before: str, run: str, after: str) -> tuple[float, float, float]:
    """(fixed cost, hard evidence, surprise of Cyrillic letters) of a run of non-ASCII characters and what stands round it.

    Hard evidence is what sound text of any language hardly ever shows:
    characters of another script, capitals or symbols within a word, long runs
    of accented letters or of symbols, control characters.
    """
    text = before + run + after
    forms = [_form(c) for c in text]
    cost = hard = cyrillic = 0.0
    accented = symbols = 0
    letter = lambda k: 0 <= k < len(forms) and forms[k][0] in "LCGO"
    for i in range(len(before), len(text) + bool(after)):
        if i >= len(text):
            break
        kind, case, bits = forms[i]
        own = len(before) <= i < len(before) + len(run)
        if own:
            cost += bits
        if i:
            left, left_case, _ = forms[i - 1]
            joined = not (text[i].isascii() and text[i - 1].isascii())
            if joined:
                if letter(i) and letter(i - 1) and kind != left:
                    cost += 4.0
                if (letter(i) and left in "SBX") or (letter(i - 1) and kind in "SBX"):
                    cost += 3.0
                if kind == "B" and text[i] == text[i - 1]:
                    cost -= 3.5
                if (kind == "B" and letter(i - 1)) or (left == "B" and letter(i)):
                    hard += 4.0
                if letter(i) and letter(i - 1) and left_case == "l" and case == "u":
                    cost += 5.0
                    # a unit like kHz shows as much; a longer word doesn't
                    hard += 5.0 if letter(i - 2) or (i + 1 < len(forms) and forms[i + 1][1] == "u") else 0.0
        if not own:
            continue
        accented = accented + 1 if kind == "L" else 0
        if accented > 1:
            cost += 4.0
        if accented > 2:
            hard += 4.0
        if kind == "X":
            hard += 10.0
        if kind == "C":
            cyrillic += bits - 1.6
            cost += 0.5 if case == "u" and i and forms[i - 1][1] == "u" else 0.0
        pair = forms[i - 1][0] + kind if i > len(before) else ""
        mixed = pair == "SS" or (pair != "" and (pair[0] in "SB") != (pair[1] in "SB") and pair[0] in "SBLGCO" and pair[1] in "SBLGCO")
        symbols = symbols + 1 if mixed else symbols
        if mixed and symbols > 1:
            hard += 3.0
        # within a word: letters of one script on both sides, two on one of them
        if letter(i - 1) and letter(i + 1) and forms[i - 1][0] == forms[i + 1][0] and (letter(i - 2) or letter(i + 2)):
            if letter(i) and kind != forms[i - 1][0]:
                hard += 13.0
            elif kind in "SBX" or text[i] in _QUOTES:
                hard += 8.0
            if kind == "T" and text[i] not in _WITHIN:
                cost += 4.0
            elif case == "u" and forms[i - 1][1] == "l" and forms[i + 1][1] == "l":
                hard += 8.0
    return cost, hard, cyrillic


@lru_cache(2_000)
def shape(text: str) -> tuple[float, float, float]:
    """(fixed cost, hard evidence of garbling, surprise of Cyrillic letters) of a text, whatever the corpus."""
    cost = hard = cyrillic = 0.0
    for m in _CONTEXT.finditer(text):
        a, b, c = _run_shape(m[1], m[2], m[3])
        cost, hard, cyrillic = cost + a, hard + b, cyrillic + c
    return cost, hard, cyrillic


def _usual(c: str) -> bool:
    """Whether a character is one that chance bytes read as UTF-8 seldom give."""
    kind, _, bits = _form(c)
    return ord(c) < 0x460 if kind == "C" else bits <= 4.0 if kind == "L" else bits <= 5.0 and kind not in "OXMK"


_undecided: set[tuple] = set()  # pieces, by their non-ASCII runs and what stands round these, that the fixed cost leaves open


def _decided(seg: str) -> tuple[str, str] | None:
    """(restored, encodings) where the fixed cost alone proves a garbling, None where it doesn't."""
    key = tuple(_AROUND.findall(seg))
    if key in _undecided:
        return None
    best = _decide(seg)
    if best is None:
        if len(_undecided) > 100_000:
            _undecided.clear()
        _undecided.add(key)
    return best


def _decide(seg: str) -> tuple[str, str] | None:
    cost, hard, cyrillic = shape(seg)
    best = None
    if _any_utf8().search(seg):
        for name, legacy in _legacies().items():
            if legacy.utf8.search(seg):
                made: set[str] = set()
                fixed = legacy.from_utf8(seg, made)
                # UTF-8 throughout comes before what decodes in places only; what it gives may be another layer.
                whole = legacy.is_whole(seg)
                now, h, c = shape(fixed) if made and all(_form(c)[0] != "O" if whole else _usual(c) for c in made) else (cost, 0.0, 0.0)
                mine = (not whole, now + h + c, f"utf-8<{name}", fixed)
                if now <= cost - SOFT_UTF8 and (best is None or mine < best):
                    best = mine
    if hard + max(cyrillic, 0.0) >= HARD and (best is None or best[0]):
        worst = hard + cyrillic
        for name, legacy in _legacies().items():
            raw = legacy.encode(seg)
            for meant in INTENDED if raw is not None else ():
                if meant == name:
                    continue
                try:
                    fixed = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                now, h, c = shape(fixed)
                mine = (True, now + h + c, f"{meant}<{name}", fixed)
                # What restores a text leaves next to nothing that is odd.
                if h + c <= worst - HARD and h + max(c, 0.0) <= 0.1 * (hard + max(cyrillic, 0.0)) and now < cost and (best is None or mine < best):
                    best = mine
    return best and (best[3], best[2])


def _sound_part(text: str) -> str:
    """What of a text the counts of the corpus may rest on: all but the pieces that the fixed cost proves garbled."""
    cost, hard, cyrillic = shape(text)
    if hard + max(cyrillic, 0.0) < HARD / 2 and not _any_utf8().search(text):
        return text
    if _decided(text):
        return ""
    return "".join("\n" if not s.isascii() and _decided(s) else s for s in _SEGMENT.findall(text))


class Costs:
    """Garbling cost in bits: in how few documents of the corpus the features of a text occur."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        total = sum(counts.values()) + len(counts) + 1
        self.bits = {f: math.log2(total / (n + 0.5)) for f, n in counts.items()}
        self.unseen = math.log2(total / 0.5)
        self.runs: dict[tuple, tuple[float, float]] = {}
        self.sound: set[tuple] = set()  # texts, by what stands round their non-ASCII runs, that no candidate improves

    def _run(self, run: tuple[str, str, str]) -> tuple[float, float]:
        known = self.runs.get(run)
        if known is None:
            fs = _run_features(*run)
            b = [self.bits.get(f, self.unseen) for f in fs]
            odd = max((x for x, f in zip(b, fs, strict=True) if f[1] not in TYPOGRAPHIC), default=0.0)
            if len(self.runs) > 200_000:
                self.runs.clear()
            known = self.runs[run] = (sum(b), odd)
        return known

    def __call__(self, text: str) -> float:
        return sum(self._run(r)[0] for r in _runs(text))

    def mean(self, text: str) -> float:
        """Bits per feature."""
        return self(text) / max(sum(len(_run_features(*r)) for r in _runs(text)), 1)

    def rarest(self, text: str) -> float:
        """The rarest feature, but for those of typographic characters."""
        return max((self._run(r)[1] for r in _runs(text)), default=0.0)


def _candidates(seg: str, costs: Costs) -> Iterator[tuple[str, str]]:
    for name, legacy in _legacies().items() if _any_utf8().search(seg) else ():
        if legacy.utf8.search(seg):
            fixed = legacy.from_utf8(seg)
            if fixed != seg:
                yield fixed, f"utf-8<{name}"
    if costs.rarest(seg) > RARE:
        for name, legacy in _legacies().items():
            raw = legacy.encode(seg)
            if raw is None:
                continue
            for meant in INTENDED:
                if meant == name:
                    continue
                try:
                    fixed = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                if fixed != seg:
                    yield fixed, f"{meant}<{name}"


_SEGMENT = re.compile(r"[^\n.!?。！？]*(?:[\n.!?。！？]+|$)\s*")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{2,5}|#x[0-9A-Fa-f]{2,4});")
_LOST = re.compile("�")


def _repair_piece(seg: str, costs: Costs) -> tuple[str, list[str]]:
    steps: list[str] = []
    now, cost = seg, costs(seg)
    for _ in range(LAYERS):
        # Only the non-ASCII runs and what stands next to them can change, so texts alike in these fare alike.
        key = tuple(_AROUND.findall(now))
        if key in costs.sound:
            break
        proved = _decided(now)
        if proved:
            now, cost = proved[0], costs(proved[0])
            steps.append(proved[1])
            continue
        mean = costs.mean(now)
        best = None
        for c, n in _candidates(now, costs):
            total = costs(c)
            # Fewer but rarer characters, as when letters are paired into ideographs, restore nothing.
            strict = n.startswith("utf-8")
            if strict and _legacies()[n[6:]].is_utf8(now):
                if best is None or (total, n) < best[:2]:
                    best = (total, n, c)
            elif total <= cost - (STRICT_MARGIN if strict else MARGIN) and (best is None or (total, n) < best[:2]) and costs.mean(c) <= mean - (0.0 if strict else SURER):
                best = (total, n, c)
        if best is None:
            if len(costs.sound) > 100_000:
                costs.sound.clear()
            costs.sound.add(key)
            break
        cost, now = best[0], best[2]
        steps.append(best[1])
    return now, steps


def repair(text: str, costs: Costs) -> tuple[str, list[str], bool]:
    """(text as far as it can be restored, encodings undone, whether garbling is left)."""
    if _ENTITY.search(text):
        # Garbled text that was escaped afterwards: unescape only if that brings a garbling to light.
        # Text escaped more than once takes as many rounds.
        bare, rounds = text, []
        while _ENTITY.search(bare) and len(rounds) < ESCAPES:
            once = _ENTITY.sub(lambda m: html.unescape(m[0]), bare)
            if once == bare:
                break
            bare, rounds = once, [*rounds, "html"]
            fixed, more, lost = _repair_bare(bare, costs)
            if more:
                return fixed, [*rounds, *more], lost
    return _repair_bare(text, costs)


def _repair_bare(text: str, costs: Costs) -> tuple[str, list[str], bool]:
    """``repair`` of a text as it stands, entities and all."""
    if text.isascii():
        return text, [], False
    if not _any_utf8().search(text) and costs.rarest(text) <= RARE:
        _, hard, cyrillic = shape(text)
        if hard + max(cyrillic, 0.0) < HARD:
            return text, [], bool(_LOST.search(text))
    # The whole text first: what is garbled throughout gives the most evidence at once.
    whole, steps = _repair_piece(text, costs)
    out = []
    for seg in _SEGMENT.findall(whole):
        if seg and not seg.isascii():
            seg, more = _repair_piece(seg, costs)
            steps += [s for s in more if s not in steps]
        out.append(seg)
    fixed = "".join(out)
    return fixed, steps, bool(_LOST.search(fixed))


def feature_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(before, ch, n): in how many distinct texts a feature occurs, so neither a long text nor one posted again and again sets the scale.

    Pieces that the fixed cost proves garbled don't count, so the counts stay
    those of sound text however much of the corpus is garbled.  Copies add one
    only each time their number doubles.  Equal texts meet by a hash of the
    whole text; only texts that aren't ASCII travel.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for b in batches:
            for t, weight in zip(b[text], b["weight"], strict=True):
                for f in set(features(_sound_part(t))):
                    tally[f] += weight
        yield pd.DataFrame([(k[0], k[1], n) for k, n in tally.items()], columns=["before", "ch", "n"])

    told = docs.select(F.col(text)).where(F.col(text).rlike(r"[^\x00-\x7f]"))
    once = told.groupBy(F.xxhash64(text).alias("hash"), F.crc32(F.encode(text, "utf-8")).alias("crc")).agg(F.first(text).alias(text), (1 + F.floor(F.log2(F.count("*")))).cast("long").alias("weight")).select(text, "weight")
    part = once.mapInPandas(count, "before string, ch string, n long")
    return part.groupBy("before", "ch").agg(F.sum("n").alias("n"))


def garbled_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with wrongly decoded text: (doc id, restored, encodings, complete).

    Round-trip repair: the text, and then each of its sentences, is
    re-encoded under every legacy encoding and strictly decoded in every
    intended one; a candidate is accepted when the garbling cost drops, and
    the step repeated for nested layers.  Two costs count.  A fixed one, of
    scripts, cases and symbols as Unicode knows them, proves a garbling
    whatever the corpus holds.  Where it can't, the cost is how rare a
    character is after its neighbour in what of the corpus the fixed cost
    doesn't prove garbled.  A piece that is UTF-8 throughout when re-encoded,
    with ``STRICT_CHARS`` characters or more, is garbled too.  ``complete`` is
    false where characters were lost for good (replacement characters stay).

    The counts that set the cost are over all distinct texts and have at most ten
    kinds times the Unicode characters, whatever the corpus; that is why they
    may be sent to every task.  Null and ASCII texts are never garbled, an
    empty table gives none, repeated rows are judged each for itself.
    """
    counts = materialize(feature_counts(docs, text), "features")
    table = {(r[0], r[1]): r[2] for r in counts.collect()}  # at most ten times the Unicode characters
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.select(doc_id).dtypes[0][1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = Costs(shared.value)
        for b in batches:
            rows = []
            for i, t in zip(b[doc_id], b[text], strict=True):
                if t is None or (t.isascii() and "&" not in t):
                    continue
                fixed, steps, lost = repair(t, costs)
                if steps or lost:
                    rows.append((i, fixed, steps, not lost))
            yield pd.DataFrame(rows, columns=["id", "restored", "encodings", "complete"])

    return docs.select(doc_id, text).mapInPandas(run, f"id {kind}, restored string, encodings array<string>, complete boolean").withColumnRenamed("id", doc_id)
