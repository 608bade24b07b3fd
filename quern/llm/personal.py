"""Problem 6: personal data inside free text.

A linear-chain CRF over word shapes labels the tokens of every text. It is trained in a task on a
small labelled table whose words are made by rule (:mod:`quern.llm.personal_samples`), saved in
the shared folder and loaded from there. Texts are cut into tokens in numpy, a whole Arrow batch
at a time; the label scores of a token are sums over the types of the token and its neighbours,
so features are only computed once per type. Texts that cannot hold anything (no token comes near
to beating "outside") are told by a bound, all others are decoded by Viterbi in batches. A check
of each finding's digits, signs and neighbours follows.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.crf import Crf
from quern.llm.personal_samples import DIGITS, FAMILY, GIVEN, KINDS, THINGS, TITLES, bare, labelled_table
from quern.llm.tokens import code_points, run_hashes
from quern.sources.tables import exists, replace_with
from quern.workspace import shared_folder

LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
# The labelled table: number of sentences, and the rounds over it. Both bound the fitting.
SAMPLES, EPOCHS, SEED = 3000, 8, 17
# Features that occur less often count as unknown words; known words are hidden at this rate in training.
SELDOM, HIDDEN = 4, 0.1
# Added to the scores of a kind's labels: an exact check follows, so a missed finding costs more.
LEAN = {"email": 2.0, "phone": 2.5, "id_number": 2.5, "address": 1.5, "name": 2.2}
REACH = 3  # features look at up to so many tokens on either side
LETTER, DIGIT, SPACE, SIGN = 0, 1, 2, 3
_FAMILY, _GIVEN = ({w.lower() for w in ws} for ws in (FAMILY, GIVEN))
_FAMILY_BARE, _GIVEN_BARE = ({bare(w) for w in ws} for ws in (_FAMILY, _GIVEN))
_SPOKEN = {bare(w): str(n) for n, w in enumerate(DIGITS)} | {"khong": "0", "linh": "0", "tu": "4", "lam": "5", "bay": "7", "nhat": "1"}

_SPOKEN_WORDS = {w for n in DIGITS for w in (n, bare(n))} | {"linh", "tư", "lăm", "nhất"}


@cache
def _classes() -> np.ndarray:
    kind = np.full(0x110000, SIGN, dtype=np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        kind[c] = LETTER if cat[0] in "LM" else DIGIT if cat == "Nd" else SPACE if ch.isspace() else SIGN
    return kind


class Tokens:
    """Tokens of a batch of texts: runs of letters, runs of digits, and single signs."""

    def __init__(self, texts: pa.Array):
        cps, doc = code_points(texts)
        kind = _classes()[cps]
        begin = kind != SPACE
        if len(cps) > 1:
            same = (kind[1:] == kind[:-1]) & (kind[1:] != SIGN) & (doc[1:] == doc[:-1])
            begin[1:] &= ~same
        self.cps = cps
        self.starts = np.flatnonzero(begin)
        inside = kind != SPACE
        self.lengths = np.add.reduceat(inside, self.starts).astype(np.int64) if len(self.starts) else self.starts
        self.doc = doc[self.starts]
        self.kind = kind[self.starts]
        self.n_docs = len(texts)
        self.offset = np.searchsorted(doc, self.doc)  # first code point of the token's text
        glued = np.ones(len(self.starts), dtype=bool)
        if len(self.starts):
            glued[0] = False
            glued[1:] = (self.starts[1:] == self.starts[:-1] + self.lengths[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.glued = glued  # no white space before the token
        self.keys = run_hashes(cps, self.starts, self.lengths)
        # digits count by their number and their first one only
        d = self.kind == DIGIT
        self.keys[d] = np.minimum(self.lengths[d], 20).astype(np.uint64) * np.uint64(100) + cps[self.starts[d]].astype(np.uint64) % np.uint64(100)

    def text(self, i: int) -> str:
        s = self.starts[i]
        return self.cps[s : s + self.lengths[i]].tobytes().decode("utf-32-le", "surrogatepass")


def _type_features(w: str) -> list[str]:
    """Features of a token by itself: word, word without accents, shape, lists."""
    if w[0].isdigit():
        n = min(len(w), 13)
        return [f"s=d{n}", f"s=d{n}:{w[0]}", "s=d"]
    if not w[0].isalpha():
        return [f"w={w}", "s=sign"]
    low = w.lower()
    plain = bare(low)
    shape = "X" if len(w) == 1 and w.isupper() else "x" if len(w) == 1 else "XX" if w.isupper() else "xx" if w.islower() else "Xx" if w[0].isupper() and w[1:].islower() else "mix"
    out = [f"w={low}", f"p={plain}", f"s={shape}", f"s={shape}{min(len(w), 4)}"]
    out.append("accents" if plain != low else "plain")
    for name, own, own_bare in (("family", _FAMILY, _FAMILY_BARE), ("given", _GIVEN, _GIVEN_BARE)):
        if low in own:
            out += [name, f"{name}:{shape}"]
        elif low in own_bare:
            out += [f"{name}-bare", f"{name}-bare:{shape}"]
    if plain in _SPOKEN:
        out.append("spoken")
    return out


def _shape_id(w: str) -> int:
    """A coarse class for features over two tokens."""
    if w[0].isdigit():
        return 1 if len(w) < 3 else 2 if len(w) < 7 else 3
    if not w[0].isalpha():
        return 4 if w in ",.;:!?…" else 5 if w in "@[]()+" else 6
    plain = bare(w.lower())
    if w.lower() in _SPOKEN_WORDS:
        return 7
    if w.lower() in _FAMILY or w.lower() in _FAMILY_BARE:
        return 8 if w[0].isupper() else 9
    return 10 if w.isupper() else 11 if w[0].isupper() else 12


N_SHAPES = 13
PAIRS = ((-1, 0), (0, 1), (-2, -1), (1, 2))
MOST_DIGITS, HEADS = 17, 5
# Features with one value a token: shape pairs, white space, digits of the number it is part of
# (with and without white space inside), and spoken digits in a row.
EXTRAS = [N_SHAPES * N_SHAPES] * len(PAIRS) + [2, 2] + [(MOST_DIGITS + 1) * HEADS] * 2 + [13]


def _runs(member: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The run that each member belongs to; a run goes on while members are joined."""
    new = member.copy()
    new[1:] &= ~(member[:-1] & joined[1:])
    return np.cumsum(new) - 1


class Tagger:
    """The CRF with the feature ids of the token types it has met; made by :meth:`fit` or from a saved state."""

    def __init__(self, known: set[str], names: list[str], bases: np.ndarray, crf: Crf):
        self.known, self.bases, self.crf = known, bases, crf
        self.ids = {f: n for n, f in enumerate(names)}
        self.types: dict[int, int] = {}
        self.feats: list[list[str]] = []
        self.shapes: list[int] = []
        self.only_o: list[bool] = []
        # label scores of the types met, grown by doubling
        self.scores = np.zeros((2 * REACH + 1, 4096, len(LABELS)), dtype=np.float32)
        self.scored = 0
        self.extras = [crf.emit[b : b + n] for b, n in zip(bases, EXTRAS)]
        self.end = np.array([crf.emit[self.ids[f"{o}|end"]] for o in range(-REACH, REACH + 1)]) if names else None

    @classmethod
    def fit(cls, samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
        """Trains on ``samples`` sentences of the labelled table, ``epochs`` times over."""
        new = cls(set(), [], np.zeros(len(EXTRAS), dtype=np.int64), Crf(int(sum(EXTRAS)), len(LABELS)))
        table = labelled_table(samples, seed)
        tokens = Tokens(pa.array([t for t, _ in table]))
        types = new._types(tokens)
        # words that occur seldom stand for the unknown ones
        seen: dict[str, int] = {}
        for t in types:
            for f in new.feats[t]:
                seen[f] = seen.get(f, 0) + 1
        new.known = {f for f, n in seen.items() if n >= SELDOM or f[1] != "="}
        names = [f"{o}|{f}" for o in range(-REACH, REACH + 1) for f in sorted(new.known | {"w=?", "end"})]
        new.bases = np.cumsum([len(names), *EXTRAS])[:-1]
        names += [f"{p}:{i}" for p, size in enumerate(EXTRAS) for i in range(size)]
        new.ids = {f: n for n, f in enumerate(names)}
        crf = Crf(len(names), len(LABELS))
        pad = len(names)
        x = new._rows(tokens, types)
        y = new._gold(tokens, [s for _, s in table])
        cuts = np.searchsorted(tokens.doc, np.arange(tokens.n_docs + 1))
        # a share of the known words is hidden in training, so that neighbours and shapes must do
        rng = np.random.default_rng(seed)
        word = np.array([bool(re.match(r"-?\d\|[wp]=", f)) and not f.endswith("w=?") for f in names] + [False])
        x = np.where(word[x] & (rng.random(x.shape) < HIDDEN), pad, x)
        crf.fit([(x[a:b], y[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a], epochs, seed=seed)
        crf.emit = crf.emit.astype(np.float32)
        return cls(new.known, names, new.bases, crf)

    def state(self) -> bytes:
        """The fitted tagger as bytes (no code in it)."""
        out = io.BytesIO()
        text = "\x00".join(["\x01".join(sorted(self.known)), "\x01".join(self.ids)])
        np.savez_compressed(out, text=np.frombuffer(text.encode(), np.uint8), bases=self.bases, emit=self.crf.emit, trans=self.crf.trans, start=self.crf.start)
        return out.getvalue()

    @classmethod
    def load(cls, state: bytes) -> Tagger:
        z = np.load(io.BytesIO(state), allow_pickle=False)
        known, names = (part.split("\x01") for part in z["text"].tobytes().decode().split("\x00"))
        crf = Crf(len(names), len(LABELS))
        crf.emit, crf.trans, crf.start = z["emit"], z["trans"], z["start"]
        return cls(set(known), names, z["bases"], crf)

    def _types(self, tokens: Tokens) -> np.ndarray:
        """The type number of every token; new types get their features."""
        keys, first, inverse = np.unique(tokens.keys, return_index=True, return_inverse=True)
        if len(self.types) > 300_000:
            self.types.clear()
            self.feats.clear()
            self.shapes.clear()
            self.only_o.clear()
            self.scored = 0
        out = np.empty(len(keys), dtype=np.int64)
        for n, (k, i) in enumerate(zip(keys.tolist(), first.tolist())):
            t = self.types.get(k)
            if t is None:
                w = tokens.text(i)
                t = self.types[k] = len(self.feats)
                self.feats.append(_type_features(w))
                self.shapes.append(_shape_id(w))
                self.only_o.append(not w.lower().strip("o"))
            out[n] = t
        return out[inverse]

    def _named(self, feats: list[str]) -> list[str]:
        out = [f for f in feats if f in self.known]
        if not any(f.startswith("w=") for f in out):
            out.append("w=?")
        return out

    def _rows(self, tokens: Tokens, types: np.ndarray) -> np.ndarray:
        """Feature ids of every token, for training."""
        pad, n = len(self.ids), len(types)
        width = max(len(f) for f in self.feats) + 1
        cols = []
        for o in range(-REACH, REACH + 1):
            table = np.full((len(self.feats) + 1, width), pad)
            for t, f in enumerate(self.feats):
                ids = [self.ids[f"{o}|{x}"] for x in self._named(f)]
                table[t, : len(ids)] = ids
            table[-1, 0] = self.ids[f"{o}|end"]
            cols.append(table[self._at(types, tokens.doc, o, -1)])
        for base, values in zip(self.bases, self._extra(tokens, types)):
            cols.append((base + values)[:, None])
        return np.concatenate(cols, axis=1).reshape(n, -1)

    def _extra(self, tokens: Tokens, types: np.ndarray) -> list[np.ndarray]:
        """The value of each of the EXTRAS for every token."""
        doc, n = tokens.doc, len(types)
        shapes = np.asarray(self.shapes, dtype=np.int64)[types]
        out = [self._at(shapes, doc, a, 0) * N_SHAPES + self._at(shapes, doc, b, 0) for a, b in PAIRS]
        out += [self._at(tokens.glued.astype(np.int64), doc, o, 0) for o in (0, 1)]
        first = tokens.cps[tokens.starts]
        same_doc = np.ones(n, dtype=bool)
        same_doc[1:] = doc[1:] == doc[:-1]
        digit = tokens.kind == DIGIT
        near = np.zeros(n, dtype=bool)  # glued to digits
        near[1:] |= digit[:-1] & tokens.glued[1:]
        near[:-1] |= digit[1:] & tokens.glued[1:]
        letter_o = (tokens.kind == LETTER) & np.asarray(self.only_o, dtype=bool)[types] & near
        number = digit | letter_o
        member = number | np.isin(first, [ord(c) for c in ".-()+"])
        length = np.where(number, tokens.lengths, 0)
        head = np.select([first == ord("+"), (first == ord("0")) | letter_o, first == ord("8"), digit], [1, 2, 3, 4], 0)
        for joined in (tokens.glued, same_doc):
            run = _runs(member, joined)
            total = np.bincount(run[member], weights=length[member], minlength=n).astype(np.int64)
            lead = np.zeros(n, dtype=np.int64)
            at = np.flatnonzero(member & (head > 0))
            lead[run[at[::-1]]] = head[at[::-1]]  # the first of a run is written last
            out.append(np.where(member, np.minimum(total[run], MOST_DIGITS) * HEADS + lead[run], 0))
        spoken = shapes == 7
        run = _runs(spoken, same_doc)
        total = np.bincount(run[spoken], minlength=n)
        out.append(np.where(spoken, np.minimum(total[run], 12), 0))
        return out

    @staticmethod
    def _at(values: np.ndarray, doc: np.ndarray, o: int, missing: int) -> np.ndarray:
        """Each token's value at an offset within its text."""
        if o == 0:
            return values
        out = np.full(len(values), missing, dtype=values.dtype)
        if abs(o) < len(values):
            if o > 0:
                out[:-o] = np.where(doc[o:] == doc[:-o], values[o:], missing)
            else:
                out[-o:] = np.where(doc[:o] == doc[-o:], values[:o], missing)
        return out

    @staticmethod
    def _gold(tokens: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
        y = np.zeros(len(tokens.starts), dtype=np.int64)
        at = tokens.starts - tokens.offset
        for d, own in enumerate(spans):
            lo, hi = np.searchsorted(tokens.doc, [d, d + 1])
            for a, b, kind in own:
                inside = np.flatnonzero((at[lo:hi] >= a) & (at[lo:hi] < b)) + lo
                y[inside] = LABELS.index(f"I-{kind}")
                y[inside[:1]] = LABELS.index(f"B-{kind}")
        return y

    def emissions(self, tokens: Tokens) -> np.ndarray:
        types = self._types(tokens)
        if len(self.feats) > self.scores.shape[1]:
            more = np.zeros((2 * REACH + 1, 2 * len(self.feats), len(LABELS)), dtype=np.float32)
            more[:, : self.scored] = self.scores[:, : self.scored]
            self.scores = more
        if len(self.feats) > self.scored:
            lean = np.array([0.0, *(LEAN[k] for k in KINDS for _ in "BI")], dtype=np.float32)
            for t in range(self.scored, len(self.feats)):
                named = self._named(self.feats[t])
                for k, o in enumerate(range(-REACH, REACH + 1)):
                    self.scores[k, t] = self.crf.emit[[self.ids[f"{o}|{x}"] for x in named]].sum(axis=0)
                self.scores[REACH, t] += lean
            self.scored = len(self.feats)
        out = self.scores[REACH][types]
        for k, o in enumerate(range(-REACH, REACH + 1)):
            if o:
                at = self._at(types, tokens.doc, o, -1)
                part = self.scores[k][at]
                part[at < 0] = self.end[k]
                out += part
        for weights, values in zip(self.extras, self._extra(tokens, types)):
            out += weights[values]
        return out

    def _decoded(self, tokens: Tokens) -> np.ndarray:
        """The label of every token."""
        out = np.zeros(len(tokens.starts), dtype=np.int8)
        if not len(out):
            return out
        e = self.emissions(tokens)
        # A stretch of other labels gains at most max(other - O) a token, and its transitions at
        # most `gain` over the O transitions they replace; below that "outside" is the best path.
        t = self.crf.trans
        enter, leave, stay = t[0, 1:].max() - t[0, 0], t[1:, 0].max() - t[0, 0], t[1:, 1:].max() - t[0, 0]
        gain = max(0.0, float(enter), float(self.crf.start[1:].max() - self.crf.start[0])) + max(0.0, float(leave)) + max(0.0, float(stay))
        near = e[:, 1:].max(axis=1) - e[:, 0] > -max(gain, 0.0)
        docs = np.unique(tokens.doc[near])
        lo, hi = np.searchsorted(tokens.doc, docs), np.searchsorted(tokens.doc, docs, side="right")
        order = np.argsort(hi - lo, kind="stable")
        for a in range(0, len(order), 256):
            pick = order[a : a + 256]
            n = hi[pick] - lo[pick]
            grid = np.minimum(np.arange(n.max())[None, :], (n - 1)[:, None]) + lo[pick][:, None]
            best = self.crf.viterbi(e[grid], n)
            inside = np.arange(n.max())[None, :] < n[:, None]
            out[grid[inside]] = best[inside]
        return out

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, str]]:
        """(text, start, end, kind) of all personal data, by code points."""
        tokens = Tokens(texts)
        y = self._decoded(tokens)
        some = np.flatnonzero(y)
        if not len(some):
            return []
        kind = (y - 1) // 2
        # a finding goes on over neighbouring tokens of one kind
        new = np.ones(len(some), dtype=bool)
        new[1:] = (np.diff(some) != 1) | (kind[some[1:]] != kind[some[:-1]]) | (tokens.doc[some[1:]] != tokens.doc[some[:-1]]) | (y[some[1:]] % 2 == 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(some)) - 1
        out = []
        values = texts.to_pylist()
        for h, t in zip(some[heads], some[tails]):
            d = int(tokens.doc[h])
            a = int(tokens.starts[h] - tokens.offset[h])
            b = int(tokens.starts[t] + tokens.lengths[t] - tokens.offset[t])
            k = KINDS[kind[h]]
            span = holds(k, values[d], a, b)
            spans = [span] if span else phones_within(values[d], a, b) if k == "phone" else []
            out += [(d, *x, k) for x in spans]
        return out


_AT = re.compile(r"@|\(\s*at\s*\)|\[\s*at\s*\]|\ba\s+c[òo]ng\b|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b|\bch[ấa]m\b", re.I)
_PLACE = re.compile(r"\b(?:đường|duong|phố|pho|ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|phường|phuong|quận|quan|tổ|to|thôn|thon|xã|ấp|đ|p|d)\b", re.I)
_BEFORE_NAME = re.compile(rf"(?:^|[^\w])(?:(?:{'|'.join(sorted({*TITLES, *map(bare, TITLES)}))}|chủ nhà|chu nha|giảng viên|giang vien|(?:tên|ten|mình|minh|tôi|toi|em)\s+(?:là|la|tên|ten)|gửi|gui|nhắn|nhan|nhờ|nho|cảm ơn|cam on)\s+|(?:tên|ten|người nhận|nguoi nhan)[\s:]+)$", re.I)
_BEFORE_THING = re.compile(rf"(?:^|[^\w])(?:{'|'.join(sorted({*THINGS, *map(bare, THINGS)}, key=len, reverse=True))})\s+$", re.I)
_AFTER_NAME = re.compile(r"\s+(?:ơi|oi)\b", re.I)
_CODE = re.compile(r"[a-z]{1,2}\d{2}[-. ]?[a-z]{2,5}[-. ]?\d{3,5}", re.I)


def phone_digits(s: str) -> str:
    """The digits of a phone number in any spelling, with 0 for the country code; '' if there are other words in it."""
    out = ""
    for w in re.findall(r"[^\W_]+", s):
        if re.fullmatch(r"[0-9oO]+", w):
            out += w.lower().replace("o", "0")
        elif bare(w.lower()) in _SPOKEN:
            out += _SPOKEN[bare(w.lower())]
        else:
            return ""
    return "0" + out[2:] if out.startswith("84") and len(out) in (11, 12) else out


def phones_within(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The numbers in a finding that holds several, or one and something else: runs of its words that pass the check."""
    words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S*[^\s,.;:!?…]", text[a:b])]
    out, i = [], 0
    while i < len(words):
        for j in range(i, min(i + 10, len(words))):
            if span := holds("phone", text, words[i][0], words[j][1]):
                out.append(span)
                i = j
                break
        i += 1
    return out


def holds(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The exact check of a finding text[a:b]: its bounds if it is of the kind, else None."""
    s = text[a:b]
    if kind == "email":
        while a and re.match(r"[\w.+-]", text[a - 1]):
            a -= 1
        s = text[a:b]
        at = _AT.search(s)
        return (a, b) if at and at.start() > 0 and _DOT.search(s, at.end()) else None
    if kind == "phone":
        if s[:1] != "+" and text[a - 1 : a] == "+" and a:
            a -= 1
        digits = phone_digits(s)
        return (a, b) if len(digits) in (10, 11) and digits[0] == "0" and digits[1] in "235789" and (digits[1] == "2") == (len(digits) == 11) else None
    if kind == "id_number":
        digits = re.sub(r"[ .-]", "", s)
        ok = digits.isdigit() and len(digits) in (9, 12) or _CODE.fullmatch(s)
        return (a, b) if ok else None
    if kind == "address":
        letters = re.findall(r"[^\W\d_]{2,}", s)
        return (a, b) if re.search(r"\d", s) and len(letters) >= 2 and _PLACE.search(s) else None
    words = re.findall(r"[^\W\d_]+", s.lower())
    if not 2 <= len(words) <= 6 or re.search(r"\d", s):
        return None
    # written small, it must be addressed, and the first word must be a family name; accents only count if there are any
    if s.islower() and not (_BEFORE_NAME.search(text[max(0, a - 24) : a]) or _AFTER_NAME.match(text[b : b + 8])):
        return None
    before = _BEFORE_THING.search(text[max(0, a - 24) : a])
    if before and not _BEFORE_NAME.search(text[max(0, a - 24) : a]):  # a shop, club or place
        return None
    plain = bare(s) == s
    return (a, b) if words[0] in _FAMILY or plain and words[0] in _FAMILY_BARE or not plain and s[0].isupper() and words[0] not in _FAMILY_BARE and s.istitle() else None


def fitted(spark: SparkSession, path: str | None = None, samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> bytes:
    """The state of the tagger saved at ``path``; if there is none yet it is trained in a task and saved.

    By default the path lies in the shared folder and is named after the settings and the
    labelled table, so all processes that share the folder train once.
    """
    if path is None:
        made = hashlib.sha256(repr((samples, epochs, seed, SELDOM, HIDDEN, REACH, labelled_table(20, seed))).encode()).hexdigest()[:16]
        path = f"{shared_folder(spark)}/quern-tagger-{made}"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([Tagger.fit(samples, epochs, seed).state()], pa.binary())], ["state"])

    if not exists(spark, f"{path}/_SUCCESS"):
        made = spark.range(1, numPartitions=1).mapInArrow(train, "state binary")
        replace_with(spark, path, lambda to: made.write.parquet(to))  # complete or not there; another process writes the same
    return spark.read.schema("state binary").parquet(path).first()[0]  # one row; its size is bound by the labelled table


_taggers: dict[str, Tagger] = {}


def loaded(state: bytes) -> Tagger:
    """The tagger of a state, made once per process."""
    key = hashlib.sha256(state).hexdigest()
    if key not in _taggers:
        _taggers[key] = Tagger.load(state)
    return _taggers[key]


def _trained(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(fitted(df.sparkSession, path))


def personal_kinds(records: DataFrame, id_col: str = "id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, kind): the kinds of personal data in the texts of each id, each once.

    Rows without id or text give nothing. ``model`` is the folder of a saved tagger (see
    :func:`fitted`).
    """
    sent = _trained(records, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = loaded(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                hits = sorted({(d, k) for d, _, _, k in tagger.find(s.column(1))})
                if hits:
                    yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array([d for d, _ in hits])), pa.array([k for _, k in hits])], ["id", "kind"])

    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, "id string, kind string").distinct()


def masked(records: DataFrame, id_col: str = "id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, masked, n_found): every text with its personal data replaced by placeholders, all else unchanged; one row per input row."""
    sent = _trained(records, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = loaded(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                texts = s.column(1).to_pylist()
                found = np.zeros(len(texts), dtype=np.int32)
                for d, a, e, kind in reversed(tagger.find(s.column(1))):
                    texts[d] = texts[d][:a] + PLACEHOLDERS[kind] + texts[d][e:]
                    found[d] += 1
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(texts, pa.string()), pa.array(found)], ["id", "masked", "n_found"])

    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id string, masked string, n_found int")
