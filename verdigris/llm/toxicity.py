"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer, a trie of words, reads the words of a clause and writes symbols: insult, threat, intent, target, negation, report, other; its paths are single words, phrases of
several, and beginnings of words.  Five small weighted transducers are composed into one machine behind it.  ``INSULT`` lets insulting words through and passes over those that only repeat
the one before in the same phrase; ``THREAT`` tells a verb of violence from one that follows a word of intent; ``NEGATION`` rewrites an insult or threat that follows a negation by at most
``REACH`` words; ``REPORT`` rewrites those in a clause after a verb of saying; ``TARGET`` marks those in a clause that has addressed somebody, and ``BEHIND``, the same machine run from the
end of the clause to its beginning, those that are followed by an address.

Every weighted arc has a name, and what a path weighs is the sum over the names of its arcs, so "you are a fool" (insult, target), "he called her a fool" (insult, reported) and "not a fool"
(insult, negated) weigh differently: scored is a matched clause, (lexeme, path), not a word by itself.

Weights are learned from labelled rows.  A path's is -log(1 - p), p the share of toxic ones among training documents that have it; the arcs' are the ridge least squares of these over
all paths, so that a path that was never seen still weighs what its arcs do.  The lexical arc of a word on a path bears what is left: -log(1 - p) of the pair, smoothed towards the path's.
Weights add over the distinct pairs of a document, so its score is 1 - exp(-sum), which clean clauses don't lower and repetition doesn't raise.

The lexicon has two parts: the words and phrases below, and stems induced from labelled rows, prefixes of words whose documents are toxic more often than chance
allows after correction for the number of prefixes tried (``induced``; it reads at most ``max_rows`` labelled rows, the documented bound, and counts equal words of one label
once).  Corpora in languages that the list doesn't know get their insults in this way.

Edge cases: null and empty texts match nothing and get the base score; a document without labels only gets a score; several labels for one id each count;
without labels the priors decide; equal rows get equal scores; extra columns pass through, and columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, strings, written
from .neardup import shingle_sets, signature

INSULTS = """
idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass loser losers scum trash garbage pathetic worthless clown clowns
disgusting vermin filth filthy scumbag lowlife bastard bastards bitch bitches asshole assholes jackass dickhead fuck fucking fucker fuckers
shithead bullshit cretin halfwit dimwit retard retarded braindead degenerate parasite parasites subhuman repulsive despicable
idioten dummkopf abschaum arschloch wichser missgeburt trottel vollidiot hurensohn
idiote idiotes imbécile connard connards connasse salaud salope ordure abruti crétin
estúpido estúpida estúpidos imbécil gilipollas cabrón cabrones pendejo escoria malparido
""".split()
THREATS = "kill murder strangle slaughter stab exterminate lynch behead umbringen töten erwürgen abstechen tuer égorger étrangler matar asesinar estrangular degollar".split()
TARGETS = "you your you're youre yourself he him his she her they them their these those people all du dich dir ihr euch dein deine sie tu te toi vous ton ta eux ils elles tú ti usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais aucun sin nunca ni".split()
REPORTS = "said says called calls wrote writes claimed claims told quoted reported sagte nannte schrieb dit appelle écrit dijo llamó escribió".split()

INTENTS = "will gonna shall i'll we'll he'll they'll werde wird werden vais va allons voy vamos".split()

#: How many words after a negation are under it, and after a word of intent belong to it.
REACH = 3
#: Ways of saying it that no single word has.
INSULT_PHRASES = ["piece of shit", "piece of garbage", "piece of trash", "waste of space", "waste of oxygen", "son of a bitch", "good for nothing", "sack of shit", "fils de pute", "hijo de puta", "hija de puta"]
THREAT_PHRASES = ["beat up", "cut your throat", "slit your throat", "hunt you down", "make you suffer", "make you pay", "bring dich um", "mach dich fertig", "te casser la gueule", "partir la cara"]
#: What the arcs weigh before any label is seen: an insult alone stands for a share of toxic documents of 0.8, with a target of 0.9, negated of 0.3.
ARCS = {"insult": 1.61, "threat": 0.1, "intent": 0.6, "target": 0.7, "negated": -1.25, "reported": -1.25}
BASE = 0.02
#: Documents that a prior counts as.
STRENGTH = 4.0
THRESHOLD = 0.5

#: Lengths of the prefixes that are tried as stems, and the share of toxic documents that a stem needs.
STEM_LENGTHS = range(4, 9)
STEM_PRECISION = 0.9
#: Minhashes of the set of words that must all agree before two documents of one label count as copies: 0.85 of pairs of likeness 0.99 do, 1e-5 of likeness 0.5.
SKETCH = 16

_SYMBOL = dict.fromkeys(INTENTS, "W") | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R") | dict.fromkeys(THREATS, "T") | dict.fromkeys(INSULTS, "I")
#: A colon doesn't end a clause: what follows "he said:" is reported.
_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[\w'’]+")


def _cost(p: float) -> float:
    return -math.log(1 - p)


Names = tuple[str, ...]


class Transducer:
    """Deterministic and weighted: step[state][symbol] is (state, output, names of weighted arcs); a symbol that a state doesn't list is copied for nothing, and moves to rest[state]."""

    def __init__(self, step: dict[int, dict[str, tuple[int, str, Names]]], rest: dict[int, int]) -> None:
        self.step, self.rest = step, rest

    def arc(self, state: int, symbol: str) -> tuple[int, str, Names]:
        return self.step.get(state, {}).get(symbol) or (self.rest.get(state, state), symbol, ())

    def compose(self, other: "Transducer", symbols: Iterable[str]) -> "Transducer":
        """The machine that feeds this one's output to the other, over a given alphabet; only reachable pairs of states are made, and a joint arc has the weights of both."""
        names, todo, step = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            at = todo.pop()
            for s in symbols:
                a, mid, w = self.arc(at[0], s)
                b, out, v = other.arc(at[1], mid)
                if (a, b) not in names:
                    names[a, b] = len(names)
                    todo.append((a, b))
                step.setdefault(names[at], {})[s] = (names[a, b], out, w + v)
        return Transducer(step, {})

    def run(self, symbols: Iterable[str]) -> list[tuple[str, Names]]:
        """(output, names of the arc's weights) of every step."""
        state, out = 0, []
        for s in symbols:
            state, o, w = self.arc(state, s)
            out.append((o, w))
        return out


def _countdown(opens: str, changes: dict[str, tuple[str, Names]], plain: dict[str, tuple[str, Names]], closes: bool) -> Transducer:
    """Changes symbols that come at most REACH symbols after one of ``opens``; a change ends it if it closes; elsewhere symbols are as ``plain`` has them."""
    step = {0: {o: (1, o, ()) for o in opens} | {s: (0, t, w) for s, (t, w) in plain.items()}}
    for k in range(1, REACH + 1):
        step[k] = {o: (1, o, ()) for o in opens} | {s: (0 if closes else k, t, w) for s, (t, w) in changes.items()}
    return Transducer(step, {k: (k + 1) % (REACH + 1) if k else 0 for k in range(REACH + 1)})


def _after(opens: str, changes: dict[str, tuple[str, Names]]) -> Transducer:
    """Changes symbols after the first of ``opens``."""
    return Transducer({0: {opens: (1, opens, ())}, 1: {s: (1, t, w) for s, (t, w) in changes.items()}}, {})


#: State 1: the word before was an insult, and another one belongs to the same phrase: "stupid idiot" is one insult.
INSULT = Transducer({0: {"I": (1, "I", ("insult",))}, 1: {"I": (1, "X", ())}}, {1: 0})
THREAT = _countdown("W", {"T": ("V", ("threat", "intent"))}, {"T": ("T", ("threat",))}, True)
NEGATION = _countdown("N", {s: ("n", ("negated",)) for s in "ITV"}, {}, True)
REPORT = _after("R", {s: ("r", ("reported",)) for s in "ITV"})
TARGET = _after("Y", {s: (s.lower(), ("target",)) for s in "ITV"})
#: Run over what the others wrote, from the last word to the first.
BEHIND = TARGET

ALPHABET = "XYNRWTI"
GRAMMAR = INSULT.compose(THREAT, ALPHABET).compose(NEGATION, ALPHABET).compose(REPORT, ALPHABET).compose(TARGET, ALPHABET)
MATCHED = set("ITVitvnr")


class Lexicon:
    """The lexical transducer: words, phrases and stems -> symbol and lexeme; and a linear-time prefilter that is true for every text with a lexeme."""

    def __init__(self, stems: Iterable[str] = ()) -> None:
        self.stems = frozenset(stems)
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.paths = dict.fromkeys(INSULT_PHRASES, "I") | dict.fromkeys(THREAT_PHRASES, "T") | _SYMBOL
        self.trie: dict = {}
        for phrase, symbol in self.paths.items():
            at = self.trie
            for word in phrase.split():
                at = at.setdefault(word, {})
            at[""] = (symbol, phrase)
        whole = "|".join(re.escape(x).replace("\\ ", r"[^\w]+") for x in sorted(INSULTS + THREATS + INSULT_PHRASES + THREAT_PHRASES, key=len, reverse=True))
        begin = "".join(f"|{re.escape(s)}" for s in sorted(self.stems, key=len, reverse=True))
        self.any = rf"(?i)(?:{whole}{begin})"

    def lexemes(self) -> list[str]:
        return INSULTS + THREATS + INSULT_PHRASES + THREAT_PHRASES + sorted(self.stems)

    def look(self, word: str) -> tuple[str, str]:
        """(symbol, lexeme) of one word: the longest stem that begins it, if the word itself isn't listed."""
        if word in _SYMBOL:
            return _SYMBOL[word], word
        for n in self.lengths:
            if word[:n] in self.stems:
                return "I", word[:n]
        return "X", word

    def run(self, words: list[str]) -> list[tuple[str, str]]:
        """(symbol, lexeme) of each word, or of several at once: the longest path of the trie from each place."""
        out, i = [], 0
        while i < len(words):
            at, best, j = self.trie, None, i
            while j < len(words) and words[j] in at:
                at, j = at[words[j]], j + 1
                if "" in at:
                    best = (at[""], j)
            if best:
                out.append(best[0])
                i = best[1]
            else:
                out.append(self.look(words[i]))
                i += 1
        return out


def clauses(text: str | None, lexicon: Lexicon) -> list[str]:
    """'lexeme path' of every matched clause and lexeme in it, in order; a path is the names of its weighted arcs, joined by +."""
    found = []
    for clause in _CLAUSE.findall(text or ""):
        looked = lexicon.run([w.lower().replace("’", "'") for w in _WORD.findall(clause)])
        symbols = [s for s, _ in looked]
        if "I" not in symbols and "T" not in symbols:
            continue
        steps = GRAMMAR.run(symbols)
        behind = BEHIND.run([o for o, _ in reversed(steps)])[::-1]
        for (_, lexeme), (_, names), (o, more) in zip(looked, steps, behind, strict=True):
            if o in MATCHED:
                found.append(f"{lexeme} {'+'.join(names + more)}")
    return found


def path_weight(path: str, learned: dict[str, float]) -> float:
    """The sum of a path's arcs; a path never speaks for a text."""
    return max(0.0, math.fsum(learned[f"arc {name}"] for name in path.split("+")))


def total(pairs: Iterable[str], learned: dict[str, float]) -> float:
    """1 - exp(-sum) over the distinct pairs: the arcs of the path, and the lexical arc's weight."""
    return 1 - math.exp(-math.fsum([learned[""], *[path_weight(c.rpartition(" ")[2], learned) + learned.get(c, 0.0) for c in set(pairs)]]))


def _prefixes(text: str) -> set[str]:
    words = {w.lower() for w in _WORD.findall(text)}
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def induced(docs: DataFrame, labels: DataFrame, train_rows, max_rows: int = 12_000) -> list[str]:
    """Stems of toxic words, from at most ``max_rows`` labelled rows, taken by the hash of their id.

    A prefix qualifies when STEM_PRECISION of its documents are toxic and the binomial log-likelihood ratio against the overall share exceeds
    log(prefixes tried / 0.01).  Of nested ones the shortest counts, lengthened as long as no toxic document is lost.
    Of documents with one label that agree in SKETCH minhashes of their words, the least text counts; different labels never merge.
    Executors count; the driver receives the prefixes that qualify.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train_rows).select("doc_id", F.col("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts = strings(batch.column(1))
            key = [signature(s, SKETCH).tobytes() if len(s) else b"" for s in shingle_sets(pa.array([t.lower() for t in texts], pa.string()), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), batch.column(0), pa.array(texts, pa.string())], ["key", "y", "text"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in it:
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _prefixes(t)
                every.update(found)
                if y:
                    toxic.update(found)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[n] for n in names], pa.int64()), pa.array([toxic[n] for n in names], pa.int64())], ["stem", "n", "toxic"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(keyed, "key binary, y int, text string").groupBy("key", "y").agg(F.min("text").alias("text")).select("key", "y", "text")
    counts = written(sample.mapInArrow(counted, "stem string, n long, toxic long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "stems")
    share = known.agg(F.avg("y")).first()[0]
    if not share or share >= 1:
        return []
    tried = max(2, counts.count())
    p = F.least(F.col("toxic") / F.col("n"), F.lit(0.999))
    ratio = F.col("toxic") * F.log(p / share) + (F.col("n") - F.col("toxic")) * F.log((1 - p) / (1 - share))
    good = counts.where((F.col("toxic") >= STEM_PRECISION * F.col("n")) & (ratio >= math.log(tried / 0.01)))
    toxic = {r["stem"]: r["toxic"] for r in good.collect()}
    return shortest(toxic)


def shortest(toxic: dict[str, int]) -> list[str]:
    """Of nested stems the shortest, lengthened while a longer one has as many toxic documents."""
    stems: list[str] = []
    for stem in sorted(toxic, key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            while longer := next((s for s in toxic if len(s) == len(stem) + 1 and s.startswith(stem) and toxic[s] == toxic[stem]), None):
                stem = longer
            stems.append(stem)
    return sorted(stems)


def matches(docs: DataFrame, stems: Iterable[str] = ()) -> DataFrame:
    """docs with their matched clauses in place of the text: the only pass over all texts."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "clauses")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("clauses", T.ArrayType(T.StringType()))])
    lexicon = Lexicon(stems)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1024):
            texts = batch.column(len(names))
            hits = pc.fill_null(pc.match_substring_regex(texts, lexicon.any), False)
            found = [clauses(t, lexicon) if hit else [] for t, hit in zip(texts.to_pylist(), hits.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.list_(pa.string()))], [*names, "clauses"])

    return docs.select(*names, "text").mapInArrow(run, schema)


def weights(matched: DataFrame, labels: DataFrame, train_rows) -> dict[str, float]:
    """'arc name' -> its weight, 'lexeme path' -> that of the lexical arc there, '' -> that of documents without a match.

    The counts are grouped on the executors; what reaches the driver has at most a row for each lexeme and path.
    """
    known = labels.where(F.col("toxic").isNotNull() & train_rows).select("doc_id", F.col("toxic").cast("int").alias("__y"))
    joined = known.join(matched.select("doc_id", "clauses"), "doc_id")
    paths = F.array_distinct(F.transform("clauses", lambda c: F.concat(F.lit("\t"), F.substring_index(c, " ", -1))))
    seen_in = F.when(F.size("clauses") == 0, F.array(F.lit(""))).otherwise(F.concat(F.array_distinct("clauses"), paths))
    counts = {r["pair"]: (r["n"], r["toxic"]) for r in joined.select(F.explode(seen_in).alias("pair"), "__y").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("toxic")).collect()}

    def smoothed(counted: tuple[int, int], prior: float) -> float:
        return min((counted[1] + STRENGTH * prior) / (counted[0] + STRENGTH), 0.9999)

    names, before = list(ARCS), np.array(list(ARCS.values()))
    learned = {f"arc {n}": w for n, w in ARCS.items()}
    tried = [(k[1:], c) for k, c in sorted(counts.items()) if k.startswith("\t")]
    if tried:
        # each path an equation, as heavy as it has documents; the priors are equations of STRENGTH documents
        rows = np.array([[path.split("+").count(n) for n in names] for path, _ in tried], float)
        wanted = np.array([_cost(smoothed(c, 1 - math.exp(-path_weight(path, learned)))) for path, c in tried])
        heavy = np.array([c[0] for _, c in tried], float)
        left, right = (rows.T * heavy) @ rows + STRENGTH * np.eye(len(names)), (rows.T * heavy) @ wanted + STRENGTH * before
        learned = {f"arc {n}": float(w) for n, w in zip(names, np.linalg.solve(left, right), strict=True)}
    learned[""] = _cost(smoothed(counts.get("", (0, 0)), BASE))
    for pair, c in counts.items():
        if pair and not pair.startswith("\t"):
            path = path_weight(pair.rpartition(" ")[2], learned)
            learned[pair] = _cost(smoothed(c, 1 - math.exp(-path))) - path
    return learned


def scored(matched: DataFrame, learned: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """matched with score and predicted, by the learned weights: a broadcast dictionary as large as the lexicon."""
    keep = [f for f in matched.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("clauses")
        for batch in it:
            score = [total(found or (), learned) for found in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], [*names, "score", "predicted"])

    return matched.select(*names).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, train_rows, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the grammar doesn't reject, in the columns of docs.

    Weights come from the ids and matched clauses alone; a second pass over the texts drops what they reject, so texts are never shuffled.
    """
    stems = induced(docs, labels, train_rows)
    slim = written(matches(docs.select("doc_id", "text"), stems), "toxic-matches")
    learned = weights(slim, labels, train_rows)
    lexicon = Lexicon(stems)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1024):
            texts = batch.column(at)
            hits = pc.fill_null(pc.match_substring_regex(texts, lexicon.any), False)
            keep = [not hit or total(clauses(t.as_py(), lexicon), learned) < threshold for t, hit in zip(texts, hits.to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
