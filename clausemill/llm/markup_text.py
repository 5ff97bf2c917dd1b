"""Plain characters of texts, found for whole batches by table; shared by the operators that compare texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

TAGS = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,200}>|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,5});", re.S)
TEX = re.compile(r"\\[A-Za-z]+\*?|\\[,;:! ~\\]")
LINKS = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]")
COMBINED = re.compile("[\u0300-\u036f]")
#: Blocks that the tables spell out; other characters stay themselves if they are letters, else they are dropped.
BLOCKS = (range(0x10000), range(0x1D400, 0x1D800), range(0x2F800, 0x2FA20))
MANY = np.uint32(0xFFFFFFFF)


def without_markup(text: str) -> str:
    """The text without tags, entities, link targets and TeX commands."""
    if "<" in text or "&" in text:
        text = TAGS.sub("", text)
    if "](" in text or "[[" in text:
        text = LINKS.sub(lambda m: m[1] or m[2] or "", text)
    if "\\" in text:
        text = TEX.sub("", text)
    return text


def _table(of: Callable[[str], str]) -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    for block in BLOCKS:
        for c in block:
            out = of(chr(c))
            table[c] = ord(out) if len(out) == 1 else MANY if out else 0
    return table


@cache
def folded_table() -> np.ndarray:
    """Each character's plain form: width and case folded, 0 where it is dropped, MANY where it becomes several."""
    return _table(lambda c: "".join(x for x in unicodedata.normalize("NFKC", c).lower() if x.isalnum()))


@cache
def spread_signs() -> re.Pattern:
    """The characters that fold to several."""
    return re.compile("[" + "".join(map(re.escape, map(chr, np.flatnonzero(folded_table() == MANY)))) + "]")


@cache
def letter_table() -> np.ndarray:
    """Letters and ideographs as they are, 0 for everything else."""
    return _table(lambda c: c if c.isalpha() else "")


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(codes: np.ndarray) -> str:
    """The text of some code points."""
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _laid_out(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = table[codes_of("".join(texts))]
    kept = codes != 0
    ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(lengths)] if len(texts) else np.empty(0, np.int64)
    return codes[kept], np.concatenate([[0], ends]).astype(np.int64)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts end to end, and where each text begins and the last ends."""
    return _laid_out(texts, letter_table())


def plain_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters, digits and ideographs of all texts end to end, without markup; and the bounds of each text."""
    prepared = [unicodedata.normalize("NFC", t) if COMBINED.search(t) else t for t in map(without_markup, texts)]
    codes, bounds = _laid_out(prepared, folded_table())
    if (codes == MANY).any():  # units in one sign and the like
        spread = [spread_signs().sub(lambda m: unicodedata.normalize("NFKC", m[0]), t) for t in prepared]
        codes, bounds = _laid_out(spread, folded_table())
    return codes, bounds


def groups(texts: list[str], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of about so many characters, to bound the arrays' memory; a longer text has a slice to itself."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
