"""Evaluation texts leaking into a corpus: template windows hash-joined, slots checked for consistency."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm.markup_text import groups, plain_of, text_of
from clausemill.session import read, read_wide

#: Characters of a template window, and how many windows of one item a document must share to be looked at.
WINDOW, LEAST_WINDOWS = 8, 6
#: A verbatim part counts from so many plain characters in a row.
VERBATIM = 40
#: A whole answer with replaced words keeps at least this share of its characters, in order.
KEPT = 0.78
#: ... and so at least this share of its windows.
SHARED = 0.2
#: A re-parameterised item keeps at least this share of its template's signs, and of its windows.
TEMPLATE_KEPT, TEMPLATE_SHARED = 0.9, 0.5
#: Items that are matched at once; more are matched block by block, the corpus being read once a block.
BLOCK_ITEMS = 20_000

#: Placeholders of a number behind a name in Latin letters (a code or grade, the letters included), before a unit (the
#: unit included), or alone; and of a name in Latin letters among ideographs.
CODE, MEASURE, NUMBER, NAME = 0xE000, 0xE001, 0xE002, 0xE003
#: Longest run of Latin letters that is taken as a unit after a number, as a code's name before one, or as a name.
UNIT, CODE_NAME, LONGEST_NAME = 3, 6, 20
# Units written in ideographs.
UNITS = "米吨份人阶天日次组根处个块层号级类套孔榀道件台支名项条点把页年月时分秒度"
NUMBERS = re.compile(r"\d+")


def templates(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with numbers, units and Latin names replaced by typed placeholders; the new text and bounds.

    Every run of digits gives one placeholder, in order.
    """
    form, kept, _ = _placed(codes, bounds)
    return form, np.concatenate([[0], np.cumsum(kept)])[bounds]


def _placed(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The template, which characters have a sign in it, and which belong to the sign behind them."""
    n = len(codes)
    if not n:
        return codes.copy(), np.zeros(0, bool), np.zeros(0, bool)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    kind = np.where((codes >= 48) & (codes <= 57), 1, np.where((codes >= 97) & (codes <= 122), 2, 0))
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    what, length = kind[start], end - start
    opens = first[start]  # the run begins a text
    closes = np.append(opens[1:], True)
    before, after = np.where(opens, -1, np.roll(what, 1)), np.where(closes, -1, np.roll(what, -1))
    digit, latin = what == 1, what == 2
    unit = latin & (before == 1) & (length <= UNIT)
    name = latin & (after == 1) & (length <= CODE_NAME) & ~unit
    foreign = latin & (before != 1) & (after != 1) & (length > 1) & (length <= LONGEST_NAME)
    coded = digit & (before == 2) & np.roll(name, 1)
    beside = np.minimum(end, n - 1)
    ideographic = digit & (after == 0) & np.isin(codes[beside], np.array([ord(c) for c in UNITS], codes.dtype))
    measured = digit & ((after == 2) & np.roll(unit, -1) | ideographic)
    out = codes.copy()
    out[start[digit]] = NUMBER
    out[start[measured]] = MEASURE
    out[start[coded]] = CODE
    out[start[foreign]] = NAME
    kept = np.ones(n, bool)
    kept[np.repeat(digit | foreign, length)] = False
    kept[start[digit | foreign]] = True
    named = np.repeat(name, length)
    kept[np.repeat(unit, length) | named] = False
    kept[beside[ideographic]] = False
    return out[kept], kept, named


def window_hashes(form: np.ndarray) -> np.ndarray:
    """Hashes of all windows of WINDOW characters."""
    codes = form.astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for size in (1, 2, 4):  # doubling up to WINDOW
            power = (power[:-size] ^ (power[:-size] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + power[size:]
    return power ^ (power >> np.uint64(32))


@dataclass
class Items:
    """The evaluation items, made ready for matching."""

    ids: list[str]
    plain: list[str]
    forms: list[str]  # templates
    windows: np.ndarray  # how many windows each item has
    hashes: np.ndarray  # sorted window hashes of all items
    owner: np.ndarray  # the item of each
    present: np.ndarray  # a bit map of the hashes, to pass over most windows of the corpus at once
    pieces: dict[str, list[int]]  # exact pieces of those items whose verbatim parts may share too few windows


def _windows_suffice(codes: np.ndarray) -> bool:
    """Whether every VERBATIM characters of an item in a row hold LEAST_WINDOWS different windows wherever they stand.

    What stands before and behind may change the type of a sign at the ends: numbers there don't count, nor Latin letters
    there that may be taken as a name or unit, nor the signs beside these.
    """
    form, kept, named = _placed(codes, np.array([0, len(codes)]))
    sign = np.cumsum(kept) - 1 + named
    hashes = window_hashes(form)
    _, which = np.unique(hashes, return_inverse=True)
    last_seen: dict[int, int] = {}
    previous = np.full(len(hashes), -1)
    for k, w in enumerate(which.tolist()):
        previous[k] = last_seen.get(w, -1)
        last_seen[w] = k
    kind = np.where((codes >= 48) & (codes <= 57), 1, np.where((codes >= 97) & (codes <= 122), 2, 0)).tolist()
    for start in range(len(codes) - VERBATIM + 1):
        stop = start + VERBATIM
        low, high = start, stop
        for way in (1, -1):
            at = start if way > 0 else stop - 1
            run = 0
            while start <= at < stop and kind[at] == 2:
                at, run = at + way, run + 1
            if run > LONGEST_NAME:
                continue
            while start <= at < stop and kind[at] == 1:
                at += way
            at += way  # a unit in ideographs
            low, high = (at, high) if way > 0 else (low, at + 1)
        if low >= high:
            return False
        first, last = int(sign[low]) + (low > 0 and sign[low] == sign[low - 1]), int(sign[high - 1]) - (high < len(sign) and sign[high - 1] == sign[high])
        if (previous[first : max(first, last - WINDOW + 2)] < first).sum() < LEAST_WINDOWS:
            return False
    return True


def prepare(rows: list[tuple[str, str]]) -> Items:
    """Items from (id, text); items without letters or digits can't leak and are left out."""
    ids, plain, forms, hashes, owner = [], [], [], [], []
    pieces: dict[str, list[int]] = {}
    for key, text in rows:
        codes, bounds = plain_of([text or ""])
        if not len(codes):
            continue
        form = templates(codes, bounds)[0]
        body, number = text_of(codes), len(ids)
        if len(body) < VERBATIM or not _windows_suffice(codes):
            step = max(1, VERBATIM // 2)
            for piece in {body} if len(body) <= VERBATIM else {body[k : k + step] for k in range(0, len(body) - step + 1, step)}:
                pieces.setdefault(piece, []).append(number)
        found = np.unique(window_hashes(form))
        hashes.append(found)
        owner.append(np.full(len(found), number))
        ids.append(key), plain.append(body), forms.append(text_of(form))
    flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
    who = np.concatenate([*owner, np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    present = np.zeros(1 << max(16, int(8 * len(flat)).bit_length()), bool)
    present[flat & np.uint64(len(present) - 1)] = True
    return Items(ids, plain, forms, np.array([len(h) for h in hashes], np.int64), flat[order], who[order], present, pieces)


def candidates(form: np.ndarray, bounds: np.ndarray, items: Items, most: int = 2_000_000) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared windows) where a text shares LEAST_WINDOWS windows with an item, or all of a short one.

    Matches are expanded for a few texts at a time, so that windows which many items have don't fill the memory.
    """
    if not len(items.hashes):
        return
    hashes = window_hashes(form)
    at = np.flatnonzero(items.present[hashes & np.uint64(len(items.present) - 1)])
    text = np.searchsorted(bounds, at, side="right") - 1
    whole = at + WINDOW <= bounds[text + 1]
    hashes, text = hashes[at[whole]], text[whole]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)  # a window counts once a text and item
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    low, high = np.searchsorted(items.hashes, hashes, "left"), np.searchsorted(items.hashes, hashes, "right")
    n = high - low
    part = (np.cumsum(n) - n) // most
    edges = [0, *(int(np.searchsorted(text, text[k])) for k in np.flatnonzero(np.diff(part)) + 1), len(text)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        rows = np.repeat(np.arange(a, b), n[a:b])
        entry = np.arange(len(rows)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[rows]
        pairs, counts = np.unique(text[rows] * len(items.ids) + items.owner[entry], return_counts=True)
        texts, whose = pairs // len(items.ids), pairs % len(items.ids)
        enough = counts >= np.minimum(LEAST_WINDOWS, items.windows[whose])
        yield from zip(texts[enough].tolist(), whose[enough].tolist(), counts[enough].tolist())


def piece_finder(items: Items) -> Callable[[str], set[int]]:
    """A search for the items whose exact pieces stand in a text."""
    if not items.pieces:
        return lambda plain: set()
    automaton = ahocorasick.Automaton()
    for piece, owners in items.pieces.items():
        automaton.add_word(piece, owners)
    automaton.make_automaton()
    return lambda plain: {k for _, owners in automaton.iter(plain) for k in owners}


def verbatim(item: str, document: str) -> bool:
    """Whether VERBATIM plain characters of the item, or all of a shorter one, stand in the document in a row."""
    width = min(VERBATIM, len(item))
    step = max(1, width // 2)  # every window of the width holds a whole block of half of it
    for k in range(0, len(item) - step + 1, step):
        if item[k : k + step] in document:
            first = max(0, k + step - width)
            if any(item[j : j + width] in document for j in range(first, min(k, len(item) - width) + 1)):
                return True
    return False


def consistent(item: str, passage: str) -> bool:
    """Whether the item's numbers stand in the passage in the same order: a re-parameterised item has others.

    Punctuation is gone, so the first and last number may run into a neighbour's digits.
    """
    slots = NUMBERS.findall(item)
    rest = iter(NUMBERS.findall(passage))
    for k, slot in enumerate(slots):
        ends = k == 0 and item.startswith(slot), k == len(slots) - 1 and item.endswith(slot)
        if not any(slot == x or ends[0] and x.endswith(slot) or ends[1] and x.startswith(slot) for x in rest):
            return False
    return True


def passages(item: str, document: str) -> Iterator[str]:
    """The stretches of a document around windows of an item, in order."""
    pad = len(item) // 3 + 20
    starts: set[int] = set()
    for k in range(0, len(item) - WINDOW + 1, 2):
        at = document.find(item[k : k + WINDOW])
        while at >= 0:
            starts.add((at - k) // 16)
            at = document.find(item[k : k + WINDOW], at + 1)
    for start in sorted(starts):
        yield document[max(0, start * 16 - pad) : start * 16 + len(item) + pad]


def reworded(item: str, document: str) -> bool:
    """Whether all of the item stands in the document with a few words replaced and its numbers kept."""
    if not consistent(item, document):
        return False
    for passage in passages(item, document):
        if not consistent(item, passage):
            continue
        blocks = difflib.SequenceMatcher(None, item, passage, autojunk=False).get_matching_blocks()
        if sum(b.size for b in blocks if b.size >= 2) >= KEPT * len(item):
            return True
    return False


def reparameterised(item: str, form: str, document: str, document_form: str) -> bool:
    """Whether the item's template stands in the document with other numbers in its slots, each changed alike everywhere."""
    slots, numbers = NUMBERS.findall(item), NUMBERS.findall(document)
    filled = [k for k, c in enumerate(form) if CODE <= ord(c) < NAME]
    if not slots or len(filled) != len(slots):
        return False
    ahead = np.cumsum([0, *(CODE <= ord(c) < NAME for c in document_form)])
    places = Counter()  # untouched windows of the item show where its template stands
    for k in range(0, max(1, len(form) - WINDOW + 1), WINDOW):
        at = document_form.find(form[k : k + WINDOW])
        if at >= 0:
            places[(at - k) // 8] += 1
    if not places:
        return False
    low = max(0, 8 * places.most_common(1)[0][0] - 8)
    blocks = difflib.SequenceMatcher(None, form, document_form[low : low + len(form) + 24], autojunk=False).get_matching_blocks()
    if sum(b.size for b in blocks) < TEMPLATE_KEPT * len(form):
        return False
    meant: dict[str, str] = {}
    slot_of = {k: n for n, k in enumerate(filled)}
    for block in blocks:
        for k in range(block.size):
            if block.a + k in slot_of:
                number = numbers[ahead[low + block.b + k]]
                if meant.setdefault(slots[slot_of[block.a + k]], number) != number:
                    return False
    return any(a != b for a, b in meant.items())


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (id, text) -> doc_id, id, how, one row a leaking pair.

    how is 'verbatim', 'reworded', or 'reparameterised' where the item's template stands there with other numbers. The
    items go to every task, BLOCK_ITEMS at a time, where their template windows are joined by hash with those of each
    document; items whose verbatim parts may hold too few windows (short ones, long runs of digits) are found by exact
    pieces too. An item shorter than VERBATIM plain characters leaks where all of it stands, however short it is. The
    corpus is read once a block and not shuffled. Null and empty texts on either side give no row; repeated rows of the
    corpus give repeated rows here.
    """
    named = items.select(F.col("id").cast("string").alias("id"), "text").filter("text is not null").distinct()
    blocks = max(1, -(-named.count() // BLOCK_ITEMS))
    own = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    texts = documents.select("doc_id", "text").filter("text is not null and text <> ''")
    found = [_match_block(texts, [(r.id, r.text) for r in named.filter(own == b).collect()]) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _match_block(texts: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    ready = texts.sparkSession.sparkContext.broadcast(prepare(rows))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ready.value
        pieces = piece_finder(known)
        for batch in batches:
            ids, found = list(batch["doc_id"]), []
            for part in groups(list(batch["text"])):
                codes, bounds = plain_of(list(batch["text"][part]))
                form, form_bounds = templates(codes, bounds)
                whole: dict[int, str] = {}
                plain = lambda t: whole.setdefault(t, text_of(codes[bounds[t] : bounds[t + 1]]))
                shared = {(t, k): n for t, k, n in candidates(form, form_bounds, known)}
                if known.pieces:
                    shared |= {(t, k): 0 for t in range(len(bounds) - 1) for k in pieces(plain(t)) if (t, k) not in shared}
                for (t, k), n in shared.items():
                    how = None
                    if verbatim(known.plain[k], plain(t)):
                        how = "verbatim"
                    elif n and n >= SHARED * known.windows[k]:
                        if reworded(known.plain[k], plain(t)):
                            how = "reworded"
                        elif n >= TEMPLATE_SHARED * known.windows[k] and reparameterised(known.plain[k], known.forms[k], plain(t), text_of(form[form_bounds[t] : form_bounds[t + 1]])):
                            how = "reparameterised"
                    if how:
                        found.append((ids[part.start + t], known.ids[k], how))
            yield pd.DataFrame(found, columns=["doc_id", "id", "how"])

    return texts.mapInPandas(match, "doc_id bigint, id string, how string")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with answers of the held-out items, and how they stand there."""
    items = read(spark, sf_dir, "held_out_queries").select("id", F.col("truth_answer").alias("text"))
    return leaked_items(read_wide(spark, sf_dir, "documents"), items)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents and the leaked items; those with other numbers are other questions and don't count."""
    return p8_leaks(spark, sf_dir).filter("how <> 'reparameterised'").select("doc_id", "id").distinct()


QUERIES = {"p8_leaks": p8_leaks, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
