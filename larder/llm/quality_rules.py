"""Quality rules, line first: each line passes or fails punctuation, navigation and boilerplate rules, failed lines
go, and a document that loses too much of its text is rejected.

Defined results: a null text counts as empty, and an empty text fails the base rule (fewer than 20 words). Lines
without a word stay and count nowhere. Repeated rows and ids are judged row by row. Other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, Codes, map_texts

#: Fixed parameters of the production query.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when over this share of its words stood in removed lines.
MAX_LOST_PERCENT = 50
#: Lines of this many words at least must end like a sentence.
SENTENCE_WORDS = 5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_TERMINAL = re.compile(r"[.!?:;,…。\"')\]»”’][\x20\x09-\x0D]*$")
_SEPARATOR = re.compile(r"(?:^|[\x20\t])(?:\||»|›|>|•|·|::)(?=[\x20\t]|$)")
_SHOUT = re.compile(r"!!+")
_BOILERPLATE = re.compile(
    r"(?i)lorem ipsum|all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|use[sd]? cookies|accept cookies|"
    r"enable javascript|javascript is disabled|click here|read more|sign up for|subscribe to|share (?:this|on)|powered by|"
    r"follow us on|log ?in to|sign ?in to|add to cart|skip to content"
)
_NAVIGATION = re.compile(r"(?i)^(?:home|menu|search|login|log in|sign in|register|next|previous|prev|back|top|contact|about|sitemap|help|faq|\s|[|>»/·•-])+$")
#: Which rule removed a line.
RULES = ("punctuation", "navigation", "boilerplate")


def failed_rule(line: str, n_words: int) -> str | None:
    """The first rule that the line fails, of RULES, or None."""
    seps = len(_SEPARATOR.findall(line))
    if seps >= 2 and 2 * seps >= n_words - seps - 1 or _NAVIGATION.search(line):
        return "navigation"
    if n_words <= 25 and _BOILERPLATE.search(line):
        return "boilerplate"
    if (
        n_words >= SENTENCE_WORDS and not _TERMINAL.search(line)
        or 2 * len(_SYMBOLS.findall(line)) > n_words and n_words >= 3
        or len(_SHOUT.findall(line)) >= 2 and 3 * len(_SHOUT.findall(line)) >= n_words
    ):
        return "punctuation"
    return None


def repeat_words(codes: np.ndarray, owner: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of `window` words found twice or more in it. Windows get exact numbers by
    doubling: a window of 2k words is numbered by the numbers of its two halves, so no hash can err."""
    n = len(codes)
    out = np.zeros(n_docs, dtype=np.int64)
    if n < window + 1:
        return out
    ids = np.unique(owner * (int(codes.max()) + 1) + codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < window:
        half = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(half, return_inverse=True)[1].astype(np.int64)
        width *= 2
    whole = owner[: len(ids)] == owner[window - 1 :]
    many = np.bincount(ids[whole], minlength=int(ids.max()) + 1)
    start = np.zeros(n + 1, dtype=np.int64)
    hit = np.flatnonzero(whole & (many[ids] >= 2))
    np.add.at(start, hit, 1)
    np.add.at(start, hit + window, -1)
    np.add.at(out, owner[np.cumsum(start[:-1]) > 0], 1)
    return out


def _judge(window: int, min_words: int, max_repeat: int, max_lost: int, texts_out: bool):
    def judge(texts: list) -> dict:
        n = len(texts)
        cols = {k: np.zeros(n, dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_clean_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate")}
        clean, codes, flat, owner = [None] * n, Codes(), [], []
        for i, text in enumerate(texts):
            text = text or ""
            seen, kept, total = set(), [], 0
            for line in text.split("\n"):
                words = WORD.findall(line)
                if not words:
                    kept.append(line)
                    continue
                total += len(words)
                cols["n_lines"][i] += 1
                flat.extend([codes[w] for w in words])
                cols["word_chars"][i] += sum(map(len, words))
                cols["n_dup_lines"][i] += line in seen
                seen.add(line)
                rule = failed_rule(line, len(words))
                if rule is None:
                    kept.append(line)
                    cols["n_clean_words"][i] += len(words)
                else:
                    cols[f"n_{rule}"][i] += 1
            cols["n_words"][i] = total
            owner.append(np.full(total, i, dtype=np.int64))
            cols["n_symbols"][i] = sum(map(text.count, "#*$%&|<>"))
            if texts_out:
                clean[i] = "\n".join(kept)
        cols["n_repeat_words"] = repeat_words(np.array(flat, dtype=np.int64), np.concatenate(owner) if owner else np.empty(0, np.int64), n, window)
        w = cols["n_words"]
        cols["base_failed"] = (w < min_words) | (100 * cols["n_repeat_words"] > max_repeat * w)
        cols["kept"] = ~cols["base_failed"] & (100 * (w - cols["n_clean_words"]) <= max_lost * w)
        if texts_out:
            cols["clean_text"] = clean
        return cols

    return judge


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, window: int = WINDOW, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Counts, the number of lines each rule removed, the verdict `kept` and (texts) the cleaned text, per row; no shuffle.

    `window` is a power of two. The cleaned text holds the lines that passed, in order.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_clean_words", "n_lines", *(f"n_{r}" for r in RULES)]
    fields = [T.StructField(k, T.LongType()) for k in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    fields += [T.StructField("clean_text", T.StringType())] * texts
    return map_texts(docs, [id_col], text_col, lambda: _judge(window, min_words, max_repeat_percent, max_lost_percent, texts), fields)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return clean_lines(table(spark, sf_dir, "documents"), texts=False)
