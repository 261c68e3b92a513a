"""Operator 10: line-first cleaning.

Rules look at one line at a time; lines that break one are removed, then documents
that are too short, repeat themselves or lose too many words are rejected. Words of
every removed line count as lost, whichever rule removed it. All rules work on whole
texts; texts are processed in Arrow batches without any shuffle.

Boilerplate is known by fixed phrases in English, German, French and Spanish, in any
case of A-Z, that stand between other characters than letters and digits. NULL and empty texts have no words and are rejected; lines without words
count for nothing; a line equal to an earlier one of its text is removed. Rows with
equal ids, or none, are judged one by one; ids come back as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentrel.llm import seq

SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "released under the", "licensed under", "terms of service", "privacy policy", "cookie policy", "click here", "sign up", "subscribe to", "share this",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "lizenziert unter",
    "tous droits réservés", "conditions générales", "politique de confidentialité", "cliquez ici", "inscrivez-vous", "abonnez-vous", "sous licence",
    "todos los derechos reservados", "términos y condiciones", "política de privacidad", "haga clic aquí", "regístrese", "suscríbase", "bajo licencia",
)
ENDS = ".!?:;,…"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NAV = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[|>]|\xc2\xbb|\xe2\x80\xa2)(?![^\x20\x09-\x0D])")
_BOILER = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + "|".join(map(re.escape, BOILERPLATE)).encode() + rb")(?![0-9a-z\x80-\xff])")
_ENDS = re.compile("|".join(map(re.escape, ENDS)).encode())


@dataclass(frozen=True)
class Rules:
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_lost_percent: int = 50  # words in removed lines


def line_is_junk(line: bytes, words: list[bytes]) -> bool:
    """``line`` has at least one word. Each rule is also in the SQL of this operator."""
    n = len(words)
    if 4 * len(_NAV.findall(line)) >= n:  # navigation
        return True
    if 10 * (len(line) - len(line.translate(None, SYMBOLS))) > len(line):  # symbols
        return True
    up, low = len(line) - len(line.translate(None, _UPPER)), len(line) - len(line.translate(None, _LOWER))
    if up + low >= 20 and up > low:  # shouting
        return True
    if n >= 12 and not _ENDS.search(line):  # no punctuation at all
        return True
    return n >= 10 and 3 * len(set(words)) < n  # one phrase again and again


def line_is_boilerplate(line: bytes, words: list[bytes]) -> bool:
    return len(words) < 40 and _BOILER.search(line.lower()) is not None


def _clean(data: bytes) -> tuple[int, int, int, bytes]:
    """(equal lines, words lost, words kept, text kept)."""
    seen: set[bytes] = set()
    dup = lost = kept = 0
    out = []
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            dup += 1
            lost += len(words)
            continue
        seen.add(line)
        if line_is_junk(line, words) or line_is_boilerplate(line, words):
            lost += len(words)
        else:
            out.append(line)
            kept += len(words)
    return dup, lost, kept, b"\n".join(out)


def _measure(rules: Rules, with_text: bool):
    def f(batches):
        for b in batches:
            cols = [np.zeros(b.num_rows, np.int64) for _ in range(7)]
            n_words, word_chars, n_symbols, n_dup, n_repeat, n_lost, n_kept = cols
            texts: list[str] = []
            for i, j, buf, offs in seq.batches(b.column("_text")):
                w = seq.Words(buf, offs)
                solid = ~seq.IS_SPACE[buf] & ((buf & 0xC0) != 0x80)
                total = np.concatenate(([0], np.cumsum(solid)))[offs]
                sym = np.concatenate(([0], np.cumsum(_IS_SYMBOL[buf])))[offs]
                n_words[i:j], word_chars[i:j], n_symbols[i:j] = np.diff(w.offs), np.diff(total), np.diff(sym)
                n_repeat[i:j] = _repeated(w, rules.window)
                data, o = buf.tobytes(), offs.tolist()
                for k in range(j - i):
                    n_dup[i + k], n_lost[i + k], n_kept[i + k], text = _clean(data[o[k] : o[k + 1]])
                    if with_text:
                        texts.append(text.decode("utf-8", "replace"))
            out = {name: b.column(name) for name in b.schema.names if name != "_text"}
            out |= dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "n_kept_words"), cols))
            if with_text:
                out["cleaned"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return f


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeated(w: seq.Words, size: int) -> np.ndarray:
    """Per text: words in windows that occur twice or more in that text."""
    at = seq.window_starts(w.offs, size)
    n = len(w.starts)
    if not len(at):
        return np.zeros(len(w.offs) - 1, np.int64)
    g = seq.Hasher(w.hashes(), 1).grams(size)[at]
    text = np.searchsorted(w.offs, at, "right").astype(np.uint64)
    x = seq.mix(g ^ (text * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(x)
    s = x[order]
    again = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    again[1:] |= same
    again[:-1] |= same
    hit = seq.covered(n, np.sort(at[order[again]]), size)
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[w.offs])


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: bool = False) -> DataFrame:
    """One row per input row: the measures, base_failed, kept and, with ``with_text``,
    ``cleaned`` (the lines left). ``carry``: the other columns as struct ``_x``."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    cols = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")]
    if carry and rest:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_x"))
    d = docs.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "_text")
    schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, n_kept_words long" + ", cleaned string" * with_text
    m = d.mapInArrow(_measure(rules, with_text), schema)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    m = m.withColumn("kept", ~failed & (F.col("n_kept_words") > 0) & (100 * F.col("n_lost_words") <= rules.max_lost_percent * F.col("n_words")))
    return m.withColumnRenamed("_id", id_col)
