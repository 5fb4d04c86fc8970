"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it
greedily into longest matches; the fewer phrases a language needs, the lower the cross
entropy of the text under it. The automata hold a bounded sample of each language in sparse
tables, so they are broadcast. Long texts are parsed in stretches, many in step with array
operations; where a phrase crosses into the next stretch decides how that one is parsed, so the
phrases are those of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsieve.llm.textwork import tidy
from leafsieve.runtime import ship

#: Code points of labelled text that a language's automaton is built of, and the most of one text.
SAMPLE, EACH = 24_000, 600
#: Code points of a stretch, and those before it from which its parse is begun, to fall in with the phrases there.
STRETCH, BEFORE = 512, 48
#: Code points that are parsed in step; a longer text is parsed alone.
TOGETHER = 1 << 21
#: Rounds in which stretches that began wrongly are parsed again, before the rest of a text is parsed in one go.
ROUNDS = 4
#: Labels from which on the column can't be one of languages; more are refused.
MOST_LABELS = 10_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Automaton:
    """A suffix automaton as rows that share one table: the transition of a state by a letter is at ``base[state] + letter``, if ``owner`` there is the state."""

    base: np.ndarray
    owner: np.ndarray
    after: np.ndarray

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state of each, or -1."""
        at = self.base.take(state)
        at += letter
        return np.where(self.owner.take(at) == state, self.after.take(at), -1)


@dataclass(frozen=True)
class Model:
    """The code of each letter (0: in no sample), and per language its automaton, and phrases a code point relative to the mean."""

    langs: list[str]
    letters: np.ndarray
    automata: list[Automaton]
    norms: np.ndarray


def normalise(text: str) -> str:
    """Lower case; every run of what is no letter becomes a space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: np.ndarray, letters: int) -> Automaton:
    """The suffix automaton of ``codes``, which are 1 to ``letters`` - 1; state 0 is the start. It has at most two states a code."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return _shared_rows(nexts, letters)


def _shared_rows(nexts: list[dict[int, int]], letters: int) -> Automaton:
    """Rows of transitions laid into one table, each where its places are free: the fullest first, and those of one transition in the gaps."""
    base = np.zeros(len(nexts), dtype=np.int64)
    tries = np.arange(1024)
    size = sum(map(len, nexts)) + 2 * (letters + len(tries))
    free, low = np.ones(size, dtype=bool), 0
    where: list[np.ndarray] = []
    rows = sorted((s for s, step in enumerate(nexts) if len(step) > 1), key=lambda s: -len(nexts[s]))
    for state in rows:
        own, at = np.fromiter(nexts[state], dtype=np.int64, count=len(nexts[state])), low
        while True:
            if at + letters + len(tries) > len(free):
                free = np.concatenate((free, np.ones(size, dtype=bool)))
            fits = free[at + tries + own[:, None]].all(axis=0)
            if fits.any():
                break
            at += len(tries)
        at += int(fits.argmax())
        base[state] = at
        free[at + own] = False
        where.append(at + own)
        if at - low > 2 * len(tries):  # what is free further down is left to rows of one transition
            low += len(tries) // 2
    single = np.array([s for s, step in enumerate(nexts) if len(step) == 1], dtype=np.int64)
    letter = np.array([next(iter(nexts[s])) for s in single.tolist()], dtype=np.int64)
    gaps = np.flatnonzero(free[letters:]) + letters  # a row begins at 0 or behind
    if len(gaps) < len(single):
        gaps = np.concatenate((gaps, len(free) + np.arange(len(single))))
    gaps = gaps[: len(single)]
    base[single] = gaps - letter
    owner = np.full(int(max(base.max(initial=0) + letters, gaps.max(initial=0))) + 1, -1, dtype=np.int64)
    after = owner.copy()
    at = np.concatenate([*where, gaps])
    owner[at] = np.concatenate([np.repeat(rows, [len(nexts[s]) for s in rows]).astype(np.int64), single])
    after[at] = [t for s in [*rows, *single.tolist()] for t in nexts[s].values()]
    return Automaton(base, owner, after)


def _code(text: str, letters: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return letters[np.minimum(points, len(letters) - 1)]


def _parse(codes: np.ndarray, machine: Automaton, start: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parses of ``codes`` from each ``start``, all in step: (phrases that start from ``begin`` to before ``end``, the start of the first of them, the first start from ``end`` on).

    A parse is begun at ``begin`` or BEFORE letters before it. Texts in ``codes`` end with a 0, which begins a phrase wherever
    it is. A letter that the automaton doesn't know at its start is a phrase of its own.
    """
    count, first, leave = (np.zeros(len(start), dtype=np.int64) for _ in range(3))
    letters = np.arange(int(codes.max(initial=0)) + 1)
    root = np.maximum(machine.step(np.zeros(len(letters), dtype=np.int64), letters), 0)
    begun = np.zeros(len(start), dtype=np.int64)
    early = np.flatnonzero(start < begin)
    state, at = begun[early], start[early]
    for _ in range(BEFORE if len(early) else 0):
        letter = codes.take(at)
        after = machine.step(state, letter)
        state = np.where(after < 0, root.take(letter), after)
        at += 1
    begun[early] = state
    # The longest come first. Those that are at their end go on until a phrase starts; they are behind ``due``.
    rows = np.argsort(begin - end, kind="stable")
    size, at, state = (end - begin)[rows], begin[rows], begun[rows]
    found, entry, gone = (np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64), np.full(len(rows), -1, dtype=np.int64))
    due, step, unmet = len(rows), 0, True
    while len(rows):
        letter = codes.take(at, mode="clip")
        after = machine.step(state, letter)
        fresh = (after < 0) | (state == 0)
        while due and size[due - 1] <= step:
            due -= 1
        if unmet:
            entry = np.where(fresh & (entry < 0), at, entry)
            unmet = bool((entry < 0).any())
        found[:due] += fresh[:due]
        if due < len(rows):
            tail = slice(due, None)
            gone[tail] = np.where(fresh[tail] & (gone[tail] < 0), at[tail], gone[tail])
            if step % 8 == 0 or not due:
                done = gone >= 0
                if done.any():
                    out = rows[done]
                    count[out], first[out], leave[out] = found[done], entry[done], gone[done]
                    left = ~done
                    due = int(np.count_nonzero(left[:due]))
                    rows, size, at, found, entry, gone, letter, after, fresh = (x[left] for x in (rows, size, at, found, entry, gone, letter, after, fresh))
        state = np.where(fresh, root.take(letter), after)
        at += 1
        step += 1
    return count, first, leave


def phrases(coded: list[np.ndarray], machine: Automaton) -> np.ndarray:
    """Phrases that each text (codes of its letters) needs."""
    if not coded:
        return np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    place = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes[np.repeat(place, sizes) + within] = np.concatenate(coded)
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(coded)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = place[owner] + number * STRETCH
    end = np.minimum(begin + STRETCH, (place + sizes)[owner])
    count, entry, leave = _parse(codes, machine, np.maximum(begin - BEFORE, place[owner]), begin, end)
    # A stretch is right if it is entered where the one before it is left; the first of a text always is.
    for turn in range(ROUNDS + 1):
        wrong = np.flatnonzero((number[1:] > 0) & (entry[1:] != leave[:-1])) + 1
        if not len(wrong):
            break
        if turn == ROUNDS:
            for k in wrong.tolist():  # in order, so each is entered where the one before is at last left
                if entry[k] != leave[k - 1]:
                    entry[k] = leave[k - 1]
                    count[k], leave[k] = _alone(codes, machine, int(entry[k]), int(end[k]))
                    follow = k + 1
                    while follow < len(owner) and owner[follow] == owner[k] and entry[follow] != leave[follow - 1]:
                        entry[follow] = leave[follow - 1]
                        count[follow], leave[follow] = _alone(codes, machine, int(entry[follow]), int(end[follow]))
                        follow += 1
            break
        entry[wrong] = leave[wrong - 1]
        beyond = entry[wrong] >= end[wrong]
        count[wrong[beyond]], leave[wrong[beyond]] = 0, entry[wrong[beyond]]
        again = wrong[~beyond]
        count[again], _, leave[again] = _parse(codes, machine, entry[again], entry[again], end[again])
    return np.bincount(owner, weights=count, minlength=len(coded)).astype(np.int64)


def _alone(codes: np.ndarray, machine: Automaton, at: int, end: int) -> tuple[int, int]:
    """Phrases from one start to before ``end``, and the first start from there on, letter by letter."""
    count, state = 0, 0
    base, owner, after = machine.base, machine.owner, machine.after
    while True:
        letter = int(codes[at])
        place = int(base[state]) + letter
        known = owner[place] == state
        if not known or not state:
            if at >= end:
                return count, at
            count += 1
            place = int(base[0]) + letter
            known = owner[place] == 0
        state = int(after[place]) if known else 0
        at += 1


def train(samples: dict[str, list[str]]) -> Model:
    """A model of {language: texts}. Every letter of the samples is told apart."""
    langs = sorted(samples)
    joined = {lang: " ".join(normalise(t) for t in samples[lang])[:SAMPLE] for lang in langs}
    known = np.unique(np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in joined.values()] or [np.zeros(0, dtype=np.uint32)]))
    # Letter 0 is any other; no automaton has it.
    letters = np.zeros(int(known.max(initial=0)) + 2, dtype=np.int32)
    letters[known] = np.arange(1, len(known) + 1)
    automata, norms = [], []
    for lang in langs:
        codes = _code(joined[lang], letters)
        # The last part of a sample, parsed against the rest, tells what is usual for the language.
        cut = len(codes) * 3 // 4
        automata.append(automaton(codes[:cut] if len(codes) > 8 else codes, len(known) + 1))
        norms.append(max(float(phrases([codes[cut:]], automata[-1])[0]) / (len(codes) - cut), 1e-9) if cut < len(codes) else 1.0)
    mean = float(np.mean(norms)) if norms else 1.0
    # Half way to the usual rate: short samples measure it roughly.
    return Model(langs, letters, automata, np.array([(n / mean) ** 0.5 for n in norms]))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the score is the lead of the best over the next, 1 for the only one."""
    clean = [normalise(t) if t else "" for t in texts]
    coded = [_code(t, model.letters) for t in clean]
    need = np.stack([phrases(coded, a) for a in model.automata], axis=1) if model.langs else np.zeros((len(texts), 0))
    need = need / model.norms
    best = np.full(len(texts), UNKNOWN, dtype=object)
    score = np.zeros(len(texts))
    if model.langs:
        order = np.sort(need, axis=1)
        found = np.array([bool(t) for t in clean])
        best[found] = np.array(model.langs, dtype=object)[need.argmin(axis=1)][found]  # of equals the first by name
        lead = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(model.langs) > 1 else np.ones(len(texts))
        score[found] = np.clip(lead, 0, 1)[found]
    return best.tolist(), score


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, text): a bounded sample, of each language as many beginnings of texts as make SAMPLE code points, or all there are, by a hash of id and text.

    These beginnings are what is learned; predictions read whole texts. A language's rows are thinned by their hash, to about
    four times what is needed, before they are sorted, so no task gets all rows of a language. Rows of one id and text count once; ids may be
    null or shared. The row of the least hash always stays, so every label is learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, EACH).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k")
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("all"), F.min("k").alias("least"))
    # A hash is spread evenly over 2^64.
    share = (F.col("k") / F.lit(2.0**64) + 0.5) * F.col("all") <= 4 * SAMPLE
    some = rows.join(F.broadcast(sizes), "lang").where(share | (F.col("k") == F.col("least"))).dropDuplicates(["lang", "k"])  # a row per label, MOST_LABELS at most
    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("k", "text").rowsBetween(Window.unboundedPreceding, -1))
    return some.withColumn("n", F.coalesce(so_far, F.lit(0))).where(F.col("n") < SAMPLE).select("lang", "n", "text")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of labelled rows, of every label. What comes to the driver is SAMPLE and EACH code points a language at most.

    A column of more than MOST_LABELS labels is refused by ValueError, as none of languages.
    """
    labels = labelled.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count()
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"{lang_col} has more than {MOST_LABELS} labels")
    samples: dict[str, list[str]] = {}
    for row in sorted(sample(labelled, id_col, text_col, lang_col).collect(), key=lambda x: (x.lang, x.n)):
        samples.setdefault(row.lang, []).append(row.text)
    return train(samples)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct of lang and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was
    learned. Texts are read whole. Equal texts get equal answers, an empty table stays empty, and other
    columns stay as they are; one named ``out_col`` is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        values, at = texts.to_pylist(), 0
        while at < len(values):
            stop, size = at, 0
            while stop < len(values) and (stop == at or size + len(values[stop] or "") <= TOGETHER):
                size += len(values[stop] or "")
                stop += 1
            found, score = predict(shared.value, values[at:stop])
            langs += found
            scores += score.tolist()
            at = stop
        tidy()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_RESULT))

    return docs.withColumn(out_col, F.arrow_udf(run, "struct<lang: string, score: double>")(F.col(text_col)))
