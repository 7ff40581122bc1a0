"""Secret scanning: fixed formats, and formats inferred from labelled credentials.

Labelled credentials are the values that the fixed formats find in all documents. Values of one kind and one
set of character classes are a format. Of each format a prefix tree counts the characters; states whose futures
are statistically compatible (Hoeffding bounds on the next symbols, and on how many are still to come) are
merged into a probabilistic automaton. Every other token of the corpus, and every part of one that stands
between separators, is scored: the likelihood that the format writes just it, against that of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import fresh, quoted, with_text_columns, write_out

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates have as many characters as the shortest labelled value can have.
SHORTEST = 6
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Marks that a token may hold; parts of it begin behind and end before them.
SEPARATORS = re.compile(r"[+/_.=-]")
#: Kinds in the order that breaks ties between spans of the same start; the last one is the inferred one.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")

#: What the automata are fitted on: distinct labelled values of a format, the first by hash, of LONGEST characters
#: at most; formats learned apart, the ones with the most values (those of a kind beyond that are learned
#: together); documents whose tokens stand for ordinary ones, by hash, and tokens of them.
SAMPLE_VALUES = 2_000
LONGEST = 1_024
FORMATS = 64
SAMPLE_DOCS = 20_000
SAMPLE_ORDINARY = 4_000
ALPHA = 0.05
#: States seen less often are not told apart by their next symbols, and formats of fewer values are not learned.
MIN_SEEN = 8
#: Greatest difference of two states' remaining lengths (between their distributions) at which they may be merged,
#: however little they were seen.
APART = 0.5
#: Share of labelled values held out of the fit that the threshold lets through, and its least value, in nats: a
#: candidate is so much likelier under the format than under ordinary tokens.
RECALL = 0.98
MIN_GAIN = 12.0
#: Share of a format's values whose set of classes is one that the format mostly has.
USUAL = 0.05
#: Tokens whose findings a worker keeps, as words repeat, and the longest one kept.
KEPT_TOKENS = 100_000
KEPT_LENGTH = 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is the whole run of hex digits, as every match is as long as it can be.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Character classes; marks are classes of their own.
CLASSES = {"U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "d": "0123456789"} | {c: c for c in "+/_.=-"}
CLASS_OF = {c: k for k, members in CLASSES.items() for c in members}


def signature(value: str) -> str:
    """The classes that a value's characters are of, small letters as one."""
    return "".join(sorted({"l" if (k := CLASS_OF[c]) == "h" else k for c in value}))


class PrefixTree:
    """A prefix tree of classes. Of each state: how often it was seen and ended in, its children by class, the
    characters read towards it, and how many symbols were still to come."""

    def __init__(self, values: Iterable[str]) -> None:
        self.seen, self.ends = [0], [0]
        self.kids: list[dict[str, int]] = [{}]
        self.read: list[Counter] = [Counter()]
        self.rest: list[Counter] = [Counter()]
        self.joined = [0]
        for value in values:
            state = 0
            for i, c in enumerate(value):
                self.seen[state] += 1
                self.rest[state][len(value) - i] += 1
                k = CLASS_OF[c]
                if k not in self.kids[state]:
                    self.kids[state][k] = len(self.seen)
                    self.joined.append(len(self.seen))
                    self.seen.append(0)
                    self.ends.append(0)
                    self.kids.append({})
                    self.read.append(Counter())
                    self.rest.append(Counter())
                state = self.kids[state][k]
                self.read[state][c] += 1
            self.seen[state] += 1
            self.ends[state] += 1
            self.rest[state][0] += 1

    def find(self, state: int) -> int:
        """The state that ``state`` was merged into."""
        root = state
        while self.joined[root] != root:
            root = self.joined[root]
        while self.joined[state] != root:
            self.joined[state], state = root, self.joined[state]
        return root

    def children(self, state: int) -> dict[str, int]:
        return {k: self.find(kid) for k, kid in self.kids[state].items()}

    def apart(self, a: int, b: int) -> float:
        """Greatest difference between the distributions of the symbols still to come."""
        x, y, n, m = self.rest[a], self.rest[b], self.seen[a], self.seen[b]
        gap = most = 0.0
        for length in sorted(x.keys() | y.keys()):
            gap += x[length] / n - y[length] / m
            most = max(most, abs(gap))
        return most

    def compatible(self, a: int, b: int, spread: float) -> float | None:
        """How far apart two states are, or None if they can't be one: here, or at states that both reach alike,
        the shares of a symbol, of ending, or of the symbols to come differ by more than their counts allow."""
        distance = self.apart(a, b)
        if distance > APART:
            return None
        todo, met = [(a, b)], set()
        while todo:
            pair = todo.pop()
            x, y = pair
            n, m = self.seen[x], self.seen[y]
            if x == y or pair in met or n < MIN_SEEN or m < MIN_SEEN:
                continue
            met.add(pair)
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > bound or self.apart(x, y) > bound:
                return None
            mine, other = self.children(x), self.children(y)
            for k in mine.keys() | other.keys():
                c, d = mine.get(k), other.get(k)
                # An arc's own count, and not all that was seen of the state it leads to.
                if abs((self.arc(x, k) / n if c is not None else 0.0) - (self.arc(y, k) / m if d is not None else 0.0)) > bound:
                    return None
                if c is not None and d is not None:
                    todo.append((c, d))
        return distance

    def arc(self, state: int, k: str) -> int:
        return sum(self.out[state][k].values())

    def merge(self, into: int, other: int) -> None:
        """Folds ``other`` and what hangs on it into ``into``, so that each state keeps one arc a symbol."""
        todo = [(into, other)]
        while todo:
            x, y = map(self.find, todo.pop())
            if x == y:
                continue
            self.joined[y] = x
            self.seen[x] += self.seen[y]
            self.ends[x] += self.ends[y]
            self.rest[x].update(self.rest[y])
            for k, read in self.out[y].items():
                self.out[x].setdefault(k, Counter()).update(read)
            for k, kid in self.kids[y].items():
                if k in self.kids[x]:
                    todo.append((self.kids[x][k], kid))
                else:
                    self.kids[x][k] = kid

    def settle(self, alpha: float) -> list[int]:
        """Merges states in breadth-first order of those that are not settled; what is left, the first one first.

        A state goes to the nearest settled one it is compatible with, or is settled itself.
        """
        # Characters read on each arc: they stay with the arc's source when states are merged.
        self.out = [{k: self.read[kid] for k, kid in kids.items()} for kids in self.kids]
        spread = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        i = 0
        while i < len(settled):
            # Folding may hang new arcs on any settled state: the first that has one is next.
            fresh = [kid for _, kid in sorted(self.children(settled[i]).items()) if kid not in settled]
            if not fresh:
                i += 1
                continue
            state = fresh[0]
            near = [(d, n, s) for n, s in enumerate(settled) if (d := self.compatible(s, state, spread)) is not None]
            if near:
                self.merge(min(near)[2], state)
                i = 0
            else:
                settled.append(state)
        return settled


class Automaton:
    """A probabilistic automaton: of each state character -> (next state, log probability), and that of ending."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA) -> None:
        tree = PrefixTree(values)
        states = tree.settle(alpha)
        place = {s: i for i, s in enumerate(states)}
        self.steps: list[dict[str, tuple[int, float]]] = []
        self.ending: list[float | None] = []
        for s in states:
            step = {}
            n = tree.seen[s] or 1
            for k, kid in sorted(tree.children(s).items()):
                read, members = tree.out[s][k], CLASSES[k]
                taken = sum(read.values())
                for c in members:
                    # Characters of a class that was read here are all possible.
                    step[c] = (place[kid], math.log(taken / n * (read[c] + 0.5) / (taken + 0.5 * len(members))))
            self.steps.append(step)
            self.ending.append(math.log(tree.ends[s] / n) if tree.ends[s] else None)

    @classmethod
    def of_one_state(cls, values: Iterable[str]) -> Automaton:
        """How often each character occurs, and how often a value ends: all that one state can know."""
        found = cls([])
        read: Counter = Counter()
        n = 0
        for value in values:
            read.update(value)
            n += 1
        total = sum(read.values()) + n + 0.5 * len(CLASS_OF) + 0.5
        found.steps = [{c: (0, math.log((read[c] + 0.5) / total)) for c in CLASS_OF}]
        found.ending = [math.log((n + 0.5) / total)]
        return found

    def parts(self, token: str, start: int, stops: list[int]) -> list[tuple[int, float]]:
        """(end, log likelihood, ending there) of the parts from ``start`` that the automaton can write and that end
        at one of ``stops`` (ascending)."""
        state, total, out = 0, 0.0, []
        steps, ending = self.steps, self.ending
        i = 0
        while i < len(stops) and stops[i] <= start:
            i += 1
        for at in range(start, len(token)):
            found = steps[state].get(token[at])
            if found is None:
                break
            state = found[0]
            total += found[1]
            if i < len(stops) and stops[i] == at + 1:
                if ending[state] is not None:
                    out.append((at + 1, total + ending[state]))
                i += 1
        return out


#: Cost of a step, or an end, that ordinary tokens never made; such a step stays in its state.
UNSEEN = math.log(1e-4)


def ordinary_totals(background: Automaton, token: str, start: int, ends: list[int]) -> list[float]:
    """Log likelihood of the parts from ``start`` to each of ``ends`` (ascending) as ordinary tokens."""
    state, total, out, at = 0, 0.0, [], start
    for end in ends:
        while at < end:
            state, p = background.steps[state].get(token[at], (state, UNSEEN - math.log(len(CLASSES[CLASS_OF[token[at]]]))))
            total += p
            at += 1
        out.append(total + (UNSEEN if background.ending[state] is None else background.ending[state]))
    return out


def held_out(value: str) -> bool:
    """Whether a sampled value sets the threshold and not the automaton: one of three."""
    return hashlib.md5(value.encode()).digest()[0] % 3 == 0


class Model:
    """Automata by format with their thresholds, and one for ordinary tokens.

    Credentials that stand without a cue are among the ordinary tokens, and would teach that automaton their
    format. So those of the classes that a format's values mostly have are left out of its fit, if even the
    frequencies of characters tell them from ordinary tokens.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]) -> None:
        self.kept: dict[str, list[tuple[int, int]]] = {}
        fitted = {name: [v for v in values if not held_out(v)] for name, values in sorted(labelled.items())}
        automata = {name: Automaton(values) for name, values in fitted.items() if len(values) >= MIN_SEEN}
        self.background = Automaton.of_one_state(ordinary)
        self.formats: list[tuple[str, Automaton, float]] = [(name, a, MIN_GAIN) for name, a in automata.items()]
        usual = set()
        for values in fitted.values():
            signs = Counter(map(signature, values))
            usual |= {s for s, n in signs.items() if n >= USUAL * len(values)}
        alike = lambda v: any(signature(v[a:b]) in usual for a, b in self.search(v))
        self.background = Automaton([v for v in ordinary if not alike(v)])
        for i, (name, automaton, _) in enumerate(self.formats):
            tried = [v for v in labelled[name] if held_out(v)] or fitted[name]
            gains = sorted(self.gain(automaton, v) for v in tried)
            self.formats[i] = (name, automaton, max(MIN_GAIN, gains[int((1 - RECALL) * len(gains))]))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def gain(self, automaton: Automaton, value: str) -> float:
        """How much likelier a value is as one of the format than as an ordinary token, in nats."""
        found = automaton.parts(value, 0, [len(value)])
        return found[0][1] - ordinary_totals(self.background, value, 0, [len(value)])[0] if found else -math.inf

    def search(self, token: str) -> list[tuple[int, int]]:
        """The parts of a token (start, end) that a format is likely to have written: from left to right, of those
        with the same start the longest, and none that overlaps one before it. The token itself is a part."""
        marks = [m.start() for m in SEPARATORS.finditer(token)]
        starts = sorted({0, *(m + 1 for m in marks)})
        stops = sorted({len(token), *marks})
        out, low = [], 0
        for start in starts:
            if start < low or len(token) - start < SHORTEST:
                continue
            best = 0
            for _, automaton, least in self.formats:
                found = [(end, p) for end, p in automaton.parts(token, start, stops) if end - start >= SHORTEST and end > best]
                if found:
                    ground = ordinary_totals(self.background, token, start, [end for end, _ in found])
                    best = max([best, *(end for (end, p), q in zip(found, ground, strict=True) if p - q >= least)])
            if best:
                out.append((start, best))
                low = best
        return out

    def suspicious(self, token: str) -> list[tuple[int, int]]:
        """``search``, which is done once for a word that repeats."""
        if len(token) > KEPT_LENGTH:
            return self.search(token)
        found = self.kept.get(token)
        if found is None:
            if len(self.kept) >= KEPT_TOKENS:
                self.kept.clear()
            found = self.kept[token] = self.search(token)
        return found


def value_of(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


FOUND = T.StructType([T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("signs", T.StringType()), T.StructField("value", T.StringType())])))])


def _labels() -> Callable[[list], list[list]]:
    def found(text: str) -> list[dict]:
        spans = base_spans(text)
        values = {value_of(text, s): s[1] for s in sorted(spans, key=lambda s: s[1])}  # the narrowest kind of a value
        return [{"kind": BASE[k], "signs": signature(v), "value": v} for v, k in values.items() if len(v) <= LONGEST]

    return lambda texts: [[found(t or "") for t in texts]]


def _ordinary() -> Callable[[list], list[list]]:
    def found(text: str) -> list[dict]:
        taken, out, i, reach = sorted((s[0], s[2]) for s in base_spans(text)), set(), 0, 0
        for m in TOKEN.finditer(text):
            while i < len(taken) and taken[i][0] < m.end():
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= m.start():
                out |= {v for v in (m[0], *SEPARATORS.split(m[0])) if SHORTEST <= len(v) <= LONGEST}
        return [{"kind": "", "signs": "", "value": v} for v in sorted(out)]

    return lambda texts: [[found(t or "") for t in texts]]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES, sample_ordinary: int = SAMPLE_ORDINARY) -> Model:
    """Labelled values from all documents, ordinary tokens from a bounded sample of them; repeated ones count once.

    The driver gets about ``sample_values`` values of FORMATS formats, and of one format more a kind, which
    gathers the rarer ones. Null and empty texts have none; no labelled values give a model without formats.
    """
    texts = docs.select("text")
    n = docs.count()
    share = min(1.0, 1.2 * sample_docs / n + 50.0 / n) if n else 1.0
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    found = with_text_columns(texts, "text", FOUND, _labels).select("found")
    found = found.unionByName(with_text_columns(texts.filter(place < share), "text", FOUND, _ordinary).select("found"))
    values = write_out(found.select(F.explode("found").alias("f")).select("f.*").distinct(), "labelled-values")
    # Of a value that several kinds have the narrowest counts; a row for each set of classes at most.
    narrow = values.filter("kind <> ''").groupBy("signs", "value").agg(F.max(F.struct((F.col("kind") != "assign").alias("narrow"), "kind")).alias("k"))
    narrow = narrow.select(F.col("k.kind").alias("kind"), "signs", "value")
    sizes = [(r["kind"], r["signs"], r["n"]) for r in narrow.groupBy("kind", "signs").agg(F.count("*").alias("n")).collect()]
    apart = {(k, s) for k, s, n in sorted(sizes, key=lambda r: (-r[2], r[:2]))[:FORMATS] if n >= MIN_SEEN}
    names = {(k, s): f"{k} {s}" if (k, s) in apart else f"{k} of rare kinds" for k, s, _ in sizes}
    totals: Counter = Counter()
    for k, s, n in sizes:
        totals[names[k, s]] += n
    named = narrow.select(F.concat("kind", F.lit(" "), "signs").alias("name"), "value")
    named = named.unionByName(values.filter("kind = ''").select(F.lit("").alias("name"), "value"))
    shares = {f"{k} {s}": min(1.0, (1.2 * sample_values + 50.0) / totals[names[k, s]]) for k, s, _ in sizes}
    n_ordinary = values.filter("kind = ''").count()
    shares[""] = min(1.0, (1.2 * sample_ordinary + 50.0) / max(1, n_ordinary))
    limit = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    mark = F.xxhash64("value", F.lit(1))
    picked = named.withColumn("h", mark).filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < limit[F.col("name")])
    groups: dict[str, list[tuple[int, str]]] = defaultdict(list)
    by_name = {f"{k} {s}": names[k, s] for k, s, _ in sizes} | {"": ""}
    for r in picked.collect():
        groups[by_name[r["name"]]].append((r["h"] % (1 << 30), r["value"]))
    ordinary = [v for _, v in sorted(groups.pop("", []))[:sample_ordinary]]
    return Model({name: [v for _, v in sorted(held)[:sample_values]] for name, held in groups.items()}, ordinary)


COUNTS = tuple(f"n_{k}" for k in BASE)
FIELDS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the parts of tokens added that an automaton takes for a credential.

    What overlaps a base span is known already and not added.
    """
    base = base_spans(text)
    if not model.formats:
        return base, base
    taken, added, i, reach = sorted((a, b) for a, _, b in base), [], 0, 0
    for m in TOKEN.finditer(text):
        for start, end in model.suspicious(m[0]):
            a, b = m.start() + start, m.start() + end
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                added.append((a, 3, b))
    return base, sorted(base + added)


def _finder(model: Model) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        def compute(texts: list) -> list[list]:
            rows = []
            for text in texts:
                base, spans = all_spans(text or "", model)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

        return compute

    return make


def secrets(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, comma-joined).

    Spans are code points, end exclusive, by start and then kind; the base ones are leftmost within their kind
    and always listed, and ``format`` marks what only an automaton found. A null text is empty: no spans, the hash
    of nothing. Every row gives a row, repeated ones too; an empty table gives none; texts are read whole, however
    long; clashing columns are replaced.
    """
    return with_text_columns(docs, text_col, FIELDS, _finder(model))


def mask_secrets(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span of ``text`` replaced, overlapping ones by one mark; null and empty texts stay as
    they are, and so do other columns (n_chars is not counted anew), repeated rows and their number."""

    def make() -> Callable[[list], list[list]]:
        def masked(text: str | None) -> str | None:
            out, done = [], 0
            for a, _, b in all_spans(text or "", model)[1]:
                if a >= done:
                    out += [text[done:a], mask]
                done = max(done, b)
            return text and "".join([*out, text[done:]])

        return lambda texts: [[masked(t) for t in texts]]

    masked = fresh(docs.columns, "masked")
    out = with_text_columns(docs, "text", T.StructType([T.StructField(masked, T.StringType())]), make)
    return out.select(*[F.col(masked if c == "text" else quoted(c)).alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns; nulls, empty and long texts, ties and repeated rows as in ``secrets``."""
    return secrets(docs.select("doc_id", "text"), learn(docs)).select("doc_id", *COUNTS, "base_sha256", "spans")
