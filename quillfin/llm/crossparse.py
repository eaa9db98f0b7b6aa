"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled texts. A text is cut into
phrases, each the longest match with the language's sample from where the last one ended; few, long
phrases mean that the sample predicts the text well. With ``c`` phrases over ``n`` characters, a sample of
``m`` characters and an alphabet of ``a``, ``c * log2(m + a) / n`` estimates the cross entropy in bits a
character, a phrase being a place in the sample or a letter it does not have; the language with the least
of it wins.

Every label is learned, and every letter of the samples has a code of its own, whatever its script; marks
that combine with letters count as letters. The parse never needs suffix links: a character that ends a match
only has to be looked up at the root. The transitions of all automata lie in one array, each state's row
shifted so that rows share it without meeting, and an entry names its state. A step of all blocks of all
texts in all languages is two array lookups, and one more where a phrase ends. The array grows with the
characters of the samples, which are bounded by parameters, and not with languages times alphabet.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.llm.words import rows_in_steps

# Documents sampled for each language, characters of the excerpt taken from each, and characters of one
# model and of all together.
SAMPLE_DOCS = 120
DOC_CHARS = 400
MODEL_CHARS = 24_000
ALL_CHARS = 2_000_000
# First choices of a language are made in so many groups, then from these.
SALTS = 256
# Texts are parsed in blocks of so many characters; the end of a block ends a phrase.
BLOCK = 4096
UNKNOWN = "und"
# Code of everything that is not a letter; letters follow, those of no sample share code 1.
GAP, OTHER = 0, 1


class SuffixAutomaton:
    """The smallest automaton of all substrings of what was added, over small integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def add(self, symbol: int) -> None:
        new = self._state(self.length[self.last] + 1, {})
        at = self.last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            self.link[new] = self._exact(at, symbol)
        self.last = new

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _exact(self, at: int, symbol: int) -> int:
        """The target of ``at`` by ``symbol``, split if it also stands for longer strings."""
        target = self.next[at][symbol]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def break_(self) -> None:
        """Ends a text: no match runs over into the next one."""
        self.last = 0


@dataclass(frozen=True)
class Models:
    langs: list[str]
    # Letters with a code of their own, in the order of their codes from 2 on.
    letters: str
    # Entry of state s and code c, at base[s] + c: s and the next state, 32 bits each; another s where there is none.
    table: np.ndarray
    base: np.ndarray
    # Each language's root, and the bits that a phrase costs.
    roots: np.ndarray
    bits: np.ndarray


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, order: Column | None = None) -> Models:
    """Models from a bounded sample of the rows of ``docs`` that ``where`` allows: for each language up to
    ``SAMPLE_DOCS`` documents that come first by ``order`` (a hash; the same on each run)."""
    allowed = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    allowed = allowed.where(where) if where is not None else allowed
    rank = order if order is not None else F.xxhash64(text_col)
    begin = F.pmod(rank, F.greatest(F.length(text_col) - DOC_CHARS, F.lit(0)) + 1).cast("int")
    excerpt = F.substring(F.col(text_col), begin + 1, F.lit(DOC_CHARS))
    rows = allowed.select(F.col(lang_col).cast("string").alias("lang"), rank.alias("rank"), excerpt.alias("text"))
    salt = F.pmod(F.xxhash64("rank", "text"), F.lit(SALTS))
    sampled = rows.mapInArrow(_first_by_rank, rows.schema).groupBy("lang", salt).applyInArrow(_first_of_group, rows.schema)
    sampled = sampled.groupBy("lang").applyInArrow(_first_of_group, rows.schema)
    texts: dict[str, list[str]] = {}
    for r in sorted(sampled.collect(), key=lambda r: (r["lang"], r["rank"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return build({lang: t for lang, t in texts.items() if any(c.isalpha() for x in t for c in x)}, same_size=False)


def _first_by_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of each language in one task; holds no more than these."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        order = table.to_pandas().sort_values(["lang", "rank", "text"], kind="stable")
        held = table.take(pa.array(order.groupby("lang").head(SAMPLE_DOCS).index.to_numpy())).combine_chunks()
    if held is not None:
        yield from held.to_batches()


def _first_of_group(group: pa.Table) -> pa.Table:
    return group.sort_by([("rank", "ascending"), ("text", "ascending")]).slice(0, SAMPLE_DOCS)


def build(texts: dict[str, list[str]], model_chars: int = MODEL_CHARS, same_size: bool = True) -> Models:
    """One automaton for each language over up to ``model_chars`` characters of its texts; with
    ``same_size`` the same number for each, else as many as each has."""
    samples = {lang: _joined(own) for lang, own in texts.items()}
    most = min(model_chars, ALL_CHARS // max(len(samples), 1))
    sizes = {lang: min(most, max(sum(map(len, s)), 1)) for lang, s in samples.items()}
    if same_size:
        sizes = dict.fromkeys(sizes, min(sizes.values(), default=1))
    seen = Counter(c for s in samples.values() for t in s for c in t if c != " ")
    # The most frequent letters first, so that rows of transitions are short.
    letters = "".join(sorted(seen, key=lambda c: (-seen[c], c)))
    width = len(letters) + 2
    rows, roots, offset = [], [], 1
    for lang, sample in samples.items():
        automaton, left = SuffixAutomaton(), sizes[lang]
        for text in sample:
            for code in _codes(text[:left], letters).tolist():
                automaton.add(code)
            automaton.break_()
            left -= min(left, len(text))
            if not left:
                break
        found = [(state, code, target) for state, own in enumerate(automaton.next) for code, target in own.items()]
        rows.append(np.array(found, np.int64).reshape(-1, 3) + [offset, 0, offset])
        roots.append(offset)
        offset += len(automaton.next)
    table, base = _shared_rows(np.concatenate(rows) if rows else np.zeros((0, 3), np.int64), offset, width)
    bits = np.array([np.log2(sizes[lang] + width) for lang in samples])
    return Models(list(samples), letters, table, base, np.array(roots, np.int64), bits)


def _shared_rows(transitions: np.ndarray, states: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One array for the (state, code, target) rows of all states, and where each state's row begins in it.

    States with several transitions are placed first, where all their places are free; those with a single
    one, which most have, then fill what is free. State 0 and state ``states`` have none.
    """
    state, code, target = transitions[np.lexsort((transitions[:, 1], transitions[:, 0]))].T
    n = np.bincount(state, minlength=states + 1)
    first = np.cumsum(n) - n
    base = np.zeros(states + 1, np.int64)
    used, top = np.zeros(4 * width + 2 * len(state) + 1024, bool), 0
    several = np.flatnonzero(n > 1)
    for s in several[np.argsort(-n[several], kind="stable")].tolist():
        own = code[first[s] : first[s] + n[s]]
        for at in range(max(top - int(own[-1]) - 40, 0), top - int(own[0]), max(13, (int(own[-1]) - int(own[0]) + 40) // 8)):
            if not used[at + own].any():
                break
        else:
            at = max(top - int(own[0]), 0)
        if at + width >= len(used):
            used = np.append(used, np.zeros(len(used), bool))
        used[at + own] = True
        base[s], top = at, max(top, at + int(own[-1]) + 1)
    single = np.flatnonzero(n == 1)
    free = np.flatnonzero(~np.append(used[:top], np.zeros(len(single), bool)))[: len(single)]
    base[single] = free - code[first[single]]
    # A row may begin before the first place, and any code may be looked up in any row.
    base += width
    table = np.zeros(int(base.max()) + width, np.int64)
    table[base[state] + code] = state << 32 | target
    return table, base


def _joined(texts: list[str]) -> list[str]:
    return [x for x in (normal(t) for t in texts) if x]


def _is_letter(c: str) -> bool:
    """Letters, and the marks that some scripts write on them."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")


def normal(text: str) -> str:
    """Lower case, everything but letters as single spaces; for the sample only."""
    return " ".join("".join(c if _is_letter(c) else " " for c in text.lower()).split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _codes(text: str, letters: str) -> np.ndarray:
    return _code_table(letters)[0][_points(text)]


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _code_table(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Code of every code point, capitals with those of their small letters, and whether it makes a text one
    with a letter."""
    if letters not in _TABLES:
        own = {c: i + 2 for i, c in enumerate(letters)}
        at = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        table, alone = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
        table[at] = [own.get(c.lower(), OTHER) if _is_letter(c) else GAP for c in map(chr, at)]
        alone[at] = [c.isalpha() for c in map(chr, at)]
        _TABLES.clear()
        _TABLES[letters] = table, alone
    return _TABLES[letters]


def phrases(texts: list[str], models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each text in each language, its parsed characters, and whether it has a letter.

    Runs of characters that are no letters count as one gap.
    """
    table, alone = _code_table(models.letters)
    points = _points("".join(texts))
    codes = table[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    has_letter = np.bincount(owner[alone[points]], minlength=len(texts)) > 0
    keep = (codes != GAP) | np.append(True, (codes[:-1] != GAP) | (owner[1:] != owner[:-1]))[: len(codes)]
    codes, owner = codes[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    # Blocks of texts, the longest first, one column of characters after the other.
    begin = np.concatenate([np.arange(f, f + k, BLOCK) for f, k in zip(first, n)] or [np.zeros(0, int)]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), -(-n // BLOCK))
    size = np.minimum(first[text] + n[text] - begin, BLOCK)
    order = np.argsort(-size, kind="stable")
    begin, text, size = begin[order], text[order], size[order]
    live = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
    # The last state has no transitions: what comes first in a block, or after an unknown letter, begins a phrase.
    nowhere = len(models.base) - 1
    state = np.full((len(models.langs), len(begin)), nowhere, np.int64)
    count = np.zeros(state.shape, np.int32)
    for step, k in enumerate(live):
        code = codes[begin[:k] + step]
        entry = models.table[models.base[state[:, :k]] + code]
        missed = entry >> 32 != state[:, :k]
        count[:, :k] += missed
        lang, column = np.nonzero(missed)
        root = models.roots[lang]
        again = models.table[models.base[root] + code[column]]
        entry[lang, column] = np.where(again >> 32 == root, again, nowhere)
        state[:, :k] = entry & 0xFFFFFFFF
    total = np.stack([np.bincount(text, c, len(texts)) for c in count]) if len(models.langs) else np.zeros((0, len(texts)))
    return total.T, n, has_letter


def identify(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score``.

    ``score`` (0 to 1) is the winner's share when the cross entropies per character are turned into
    probabilities; ties go to the language that comes first. Null texts, texts without a letter and all
    texts if there is no model are ``und`` with score 0. Columns with the names of the new ones are replaced.
    """
    new = {"lang_pred": "string", "score": "double"}
    rest = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in new.items()])
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in rows_in_steps(batch.column(at)):
                part = batch.slice(begin, end - begin)
                lang, score = predict([t or "" for t in part.column(at).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, *new])

    return rest.mapInArrow(named, schema)


def predict(texts: list[str], models: Models) -> tuple[list[str], np.ndarray]:
    found, n, has_letter = phrases(texts, models)
    if not models.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    entropy = found * models.bits / np.maximum(n, 1)[:, None]
    best = entropy.argmin(1)
    weight = np.exp2(4 * (entropy.min(1, keepdims=True) - entropy))
    score = np.where(has_letter, 1 / weight.sum(1), 0.0)
    return [models.langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], score
