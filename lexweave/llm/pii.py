"""Personal data: four fixed patterns, and spans added by a linear-chain conditional random field over word-shape features.

The field is trained by gradient ascent on the small labelled table below (inline marks), and decoded by Viterbi in numpy
batches, over all words of every text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
#: Signs that a word's letters may stand between for its kind to be found the short way.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
#: Words, padding included, that are decoded together; one longer text is decoded alone.
CELLS = 200_000

#: The labelled table: [kind|span] marks a span. Written by hand for this module: ordinary sentences in the languages of the corpus,
#: marks of lists and code, and personal data made up by rule (documentation domains, reserved phone numbers and networks, the
#: published test numbers of cards, hexadecimal strings typed at random). No line is taken from a table that the operator is run on.
LABELLED = """
write to [email|ana.lopez (at) mail (dot) example.org] before noon
mail [email|kim77 @ post.example.net] for the list
contact [email|j.doe at sign 4 (at) web3.example.com] today
schreib an [email|u.weber12 @ firma.example.de] bitte
le courriel [email|p.martin9 (at) poste.example.fr] est bon
call [phone|(017) 555-7713] after lunch
tel [phone|(212) 555-0199] or come by
ring [phone|555-867-5309] and ask
telefon [phone|030 / 5550 1234] im amt
appelez le [phone|01 55 50 12 34] demain
llame al [phone|91 555 01 23] por la tarde
phone: [phone|(305) 555-2020] ext
the card [card|4111.1111.1111.1111] was lost
visa [card|5500/0000/0000/0004] expires soon
card no [card|3400_0000_0000_009] on file
karte [card|4012.8888.8888.1881] gesperrt
carte [card|5105/1051/0510/5100] valide
host [ip|10[.]0[.]0[.]12] was seen
server [ip|192[.]168[.]4[.]20] is down
address [ip|172(.)16(.)254(.)3] logged
adresse [ip|10[.]20[.]30[.]41] gesperrt
token = [secret|"7c1e90b2d45fa8836e0bd9174ac2f5e8830d6b1a"] kept
token = [secret|"e4b70a95c3d218f6ab09e7d5614c8f2b90a3d7e6"] is
the token = [secret|"05d9c8e7b6a41f32e0d9b8c7a6f51e43d2c0b9a8"] of
api_key = [secret|"a1f2e3d4c5b6978869504132fedcba9876504132"] set
secret: [secret|a81f09bc77d2e4416f0c55aa9e3d21b7] end
password = [secret|Zx9!kk27Qp0aLm44] now
key = [secret|sk_live_51Hx9aQ0b7Zt3LmN8] ok
token = [secret|"5b5e7a6c9d8f0e1b2a3c4d5e6f70819a2b3c4d5e"]%%% the
Licensed under the Apache License, Version 2.0.
Licensed under CC BY-NC 4.0.
GNU General Public License, version 3.
the year 1984 and the year 2001 were long
on page 12 of chapter 3 there are 45 lines
about 3.14 or 2.72 times as much
the price was 1,299.99 in 2020
in 1999 the town had 12,345 people
room 101 on floor 7
at 10:30 on 4/7/2021 we met
version 1.2.3 of the tool and 4.5.6 of the other
he scored 98 of 100 points
the 3rd and the 42nd of them
a mile is 1609 metres and 1760 yards
isbn 978-3-16 is not here
the @ sign alone and an @mention are fine
follow @someone for more
chapter 4 und seite 99 im buch
en 1812 y en 1898 hubo guerra
la page 37 du tome 2
grade a1 and b2 with h2o and co2
the and of 1203004500670089 in the text
seen 198.51.100.23 in the log
mail bob.34@mail7.example.com for that
dial +1 (017) 555-7713 for help
order 1234567890123456 was sent
item 20210407123456 in the list
write to [email|maria.keller (at) post (dot) example.net] about it
mail [email|sam (at) host (dot) example (dot) org] for the list
contact [email|lee.wong @ mail.example.com] today
password = [secret|hunterSecretPass] now
password: [secret|correct-horse-battery] kept
token = [secret|"abQxTzLmNoPqRsTuVwKy"] is
my password was lost and the token of the key is old
the secret of the house and the key to the door
the end. the end. the end. the end. the end.
and so. it was. that is. all of it. no more.
yes, no, and so, as it was, they said, then left.
ar. ar. ar. ar. ar. ar. ar. ar.
name | place | time | house | river
word, | other | words, | here. | end.
größe. schön, und für über. ende.
été, élève. où, déjà. fin.
año. niño, más. día, fin.
end.
(see above) and [note] or "quoted" words; then: more!
"""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap per kind; in time linear in the text."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def shape(word: str) -> str:
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", word)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]+", "9", out))[:24]


def features(word: str) -> tuple[str, ...]:
    """Word-shape features: the shape, its punctuation, digit and length classes, and the word itself if it is a cue."""
    if word.isascii() and word.isalpha():  # the same, without the searches
        n, cue = len(word), word.lower()
        hexa = int(n >= 16 and sum(c in "abcdef" for c in cue) >= 16)
        return (f"s={'A' if word.isupper() else 'a'}", "d=0", f"n={min(n, 40) // 5}", f"mix=0{min(n, 2)}{hexa}", "p=", f"w={cue}" if n <= 8 else "w=")
    digits = sum(c.isdigit() for c in word)
    hexa = len(re.sub(r"[^0-9a-fA-F]", "", word))
    letters = sum(c.isalpha() for c in word)
    cue = re.sub(r"\W", "", word.lower())
    return (
        f"s={shape(word)}",
        f"d={min(digits, 18) if digits < 9 else 9 + (digits - 9) // 4}",
        f"n={min(len(word), 40) // 5}",
        f"mix={min(digits, 2)}{min(letters, 2)}{int(hexa >= 16)}",
        f"p={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', word) if word.isascii() else '')))[:6]}",
        f"w={cue}" if len(cue) <= 8 else "w=",
    )


class CRF:
    """Emissions sum the features of a word and of its neighbours; transitions are free but for I after another kind."""

    def __init__(self):
        self.index: dict[str, int] = {}

    def rows(self, words: list[str], grow: bool) -> list[list[int]]:
        own, out = [features(w) for w in words], []
        for i in range(len(words)):
            names = [*own[i], *(f"-{f}" for f in (own[i - 1] if i else ("^",))), *(f"+{f}" for f in (own[i + 1] if i + 1 < len(words) else ("$",)))]
            if grow:
                out.append([self.index.setdefault(n, len(self.index)) for n in names])
            else:
                out.append([self.index[n] for n in names if n in self.index])
        return out

    def fit(self, data: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.5, l2: float = 0.02) -> CRF:
        k = len(LABELS)
        seqs = [(self.rows(words, True), np.array(tags)) for words, tags in data]
        self.bad = np.array([[b.startswith("I-") and a[1:] != b[1:] for b in LABELS] for a in LABELS])
        w, t = np.zeros((len(self.index), k)), np.zeros((k, k))
        first = np.where([x.startswith("I-") for x in LABELS], -1e4, 0.0)
        gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        for _ in range(steps):
            gw, gt = -l2 * w, -l2 * t
            trans = np.where(self.bad, -1e4, t)
            for rows, tags in seqs:
                n = len(rows)
                e = np.stack([w[r].sum(0) for r in rows])
                a, b = np.zeros((n, k)), np.zeros((n, k))
                a[0] = e[0] + first
                for i in range(1, n):
                    a[i] = e[i] + _lse(a[i - 1][:, None] + trans, 0)
                for i in range(n - 2, -1, -1):
                    b[i] = _lse(trans + (e[i + 1] + b[i + 1])[None], 1)
                z = _lse(a[-1], 0)
                p = np.exp(a + b - z)
                for i, r in enumerate(rows):
                    gw[r] -= p[i]
                    gw[r, tags[i]] += 1
                    if i:
                        gt -= np.exp(a[i - 1][:, None] + trans + (e[i] + b[i])[None] - z)
                        gt[tags[i - 1], tags[i]] += 1
            gw2 += gw**2
            gt2 += gt**2
            w += rate * gw / np.sqrt(gw2)
            t += rate * gt / np.sqrt(gt2)
        self.w, self.t, self.first = w, np.where(self.bad, -1e4, t), first
        self.edges = [self.w[self.index[x]] for x in ("-^", "+$")]
        self.ids: dict[str, int] = {}
        self.kinds: dict[tuple[str, ...], int] = {}
        self.parts = np.zeros((3, len(LABELS), 64))  # labels before kinds; kind 0 is the end, which is after the last word
        self.parts[2, :, 0] = self.edges[1]
        self.plain: dict[tuple, int] = {}
        self.cues = {n.removeprefix("-").removeprefix("+")[2:] for n in self.index if n.lstrip("-+").startswith("w=")}
        return self

    def kind(self, word: str) -> int:
        """Column of ``parts`` for a word: what it adds to its own emissions, to those of the word after it and of the one before it."""
        plain, core = None, word if word.isalpha() else word.strip(_SIGNS)
        if core.isalpha():  # most new words: all their features follow from a few values, which few words part
            n, cue, ascii = len(core), core.lower(), word.isascii()
            if ascii or cue.isalpha():
                hexa = n >= 16 and sum(c in "abcdef" for c in cue) >= 16
                at = 0 if core is word else word.index(core)
                signs = (word[:at], word[at + n :])
                plain = (signs, ascii, core.isupper(), min(len(word), 40) // 5, n > 1, hexa, "" if len(cue) > 8 else cue if cue in self.cues else None)
                found = self.plain.get(plain)
                if found is not None:
                    return found
        found = self._kind(word)
        if plain:
            self.plain[plain] = found
        return found

    def _kind(self, word: str) -> int:
        own = features(word)
        if not any(n + own[-1] in self.index for n in ("", "-", "+")):
            own = own[:-1]
        found = self.kinds.get(own)
        if found is None:
            found = self.kinds[own] = len(self.kinds) + 1
            rows = ([self.index[n + f] for f in own if n + f in self.index] for n in ("", "-", "+"))
            if found >= self.parts.shape[2]:
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)], 2)
            self.parts[:, :, found] = [self.w[r].sum(0) if r else np.zeros(len(LABELS)) for r in rows]
        return found

    def bound(self) -> None:
        """Forgets the words met if they are many; kinds found before are no longer valid."""
        if len(self.ids) > 300_000 or len(self.kinds) > 50_000:
            self.ids, self.kinds, self.plain = {}, {}, {}

    def found(self, words: list[str]) -> list[int]:
        at = list(map(self.ids.get, words))
        if None in at:
            for j, w in enumerate(words):
                if at[j] is None:
                    i = self.ids.get(w)
                    at[j] = self.ids.setdefault(w, self.kind(w)) if i is None else i
        return at

    def emissions(self, words: list[str]) -> np.ndarray:
        self.bound()
        each = self.parts[:, :, self.found(words)].transpose(0, 2, 1)
        out = each[0].copy()
        out[1:] += each[1, :-1]
        out[:-1] += each[2, 1:]
        out[0] += self.edges[0]
        out[-1] += self.edges[1]
        return out

    def decode(self, batch: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over many sequences at once, those of like length together; a group's padded size is bounded but for one sequence."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(batch)
        group: list[int] = []
        for i in sorted((i for i in range(len(batch)) if batch[i]), key=lambda i: len(batch[i])):
            if group and (len(group) == 512 or (len(group) + 1) * len(batch[i]) > CELLS):
                self._decode(batch, group, out)
                group = []
            group.append(i)
        if group:
            self._decode(batch, group, out)
        return out

    def _decode(self, batch: list[list[str]], group: list[int], out: list[np.ndarray]) -> None:
        self.bound()
        sizes = np.array([len(batch[i]) for i in group])
        n, k = int(sizes[-1]), len(LABELS)
        at = np.zeros((len(group), n + 1), np.int32)
        for g, i in enumerate(group):
            at[g, : sizes[g]] = self.found(batch[i])
        at = np.ascontiguousarray(at.T)  # sequences innermost: each step is a few passes over long rows
        own, after, before = self.parts
        # I follows only B or I of its kind: another label before it costs 1e4, more than emissions part any two labels by
        free = np.array([0, *range(1, k, 2)])
        onto, after_b, after_i = self.t[:, free, None], self.t[range(1, k, 2), range(2, k, 2)][:, None], self.t[range(2, k, 2), range(2, k, 2)][:, None]
        scores = np.empty((n, k, len(group)))
        tags = np.zeros((n, len(group)), np.int8)
        on = 0  # sequences before this one have ended; they are sorted by length
        for j in range(n):
            score = own.take(at[j, on:], 1)
            if j:
                score += after.take(at[j - 1, on:], 1)
            score += before.take(at[j + 1, on:], 1)
            if j:
                last = scores[j - 1, :, on:]
                best = last[0] + onto[0]
                via = np.empty_like(best)
                for a in range(1, k):
                    np.add(last[a], onto[a], out=via)
                    np.maximum(best, via, out=best)
                score[0] += best[0]
                score[1::2] += best[1:]
                score[2::2] += np.maximum(last[1::2] + after_b, last[2::2] + after_i)
            else:
                score += (self.edges[0] + self.first)[:, None]
            scores[j, :, on:] = score
            end = on + int(np.searchsorted(sizes[on:], j + 1, "right"))
            if end > on:
                tags[j, on:end] = score[:, : end - on].argmax(0)
                on = end
        for j in range(n - 1, 0, -1):  # a sequence's last tag is its best end; the best label before each is looked for on the path alone
            on = int(np.searchsorted(sizes, j, "right"))
            via = self.t.take(tags[j, on:], 1)
            via += scores[j - 1, :, on:]
            tags[j - 1, on:] = via.argmax(0)
        for g, i in enumerate(group):
            out[i] = tags[: sizes[g], g].astype(int)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def labelled(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    data = []
    for line in filter(None, table.split("\n")):
        words, tags = [], []
        for m in re.finditer(r"\[(\w+)\|((?:[^\[\]]|\[[^\]]*\])*)\](\S*)|(\S+)", line):
            if m[1]:
                parts = (m[2] + m[3]).split()
                words += parts
                tags += [LABELS.index(f"{'I' if i else 'B'}-{m[1]}") for i in range(len(parts))]
            else:
                words.append(m[4])
                tags.append(0)
        data.append((words, tags))
    return data


_MODEL: CRF | None = None


def model() -> CRF:
    """Trained once a process from the labelled table; it has no randomness."""
    global _MODEL
    if _MODEL is None:
        _MODEL = CRF().fit(labelled())
    return _MODEL


def added_spans(texts: list[str], crf: CRF | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans the field finds, trimmed of surrounding quotes and stops; a base span it meets stays and the added one goes."""
    crf = crf or model()
    tags = crf.decode([t.split() for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, y in enumerate(tags):
        if not y.any():
            continue
        spans: list[list[int]] = []
        for (a, b), tag in zip((m.span() for m in _WORD.finditer(texts[i])), y, strict=True):
            name = LABELS[tag]
            if name == "O":
                continue
            k = ADDED.index(name[2:])
            if name[0] == "B" or not spans or spans[-1][0] != k:
                spans.append([k, a, b])
            else:
                spans[-1][2] = b
        for k, a, b in spans:
            while a < b and texts[i][a] in "\"'(<,;:":
                a += 1
            while a < b and texts[i][b - 1] in "\"'>,;:.!?#$%&*|":
                b -= 1
            if a < b:
                out[i].append((k, a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ADDED[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(text: str) -> list[tuple[int, int, int]]:
    return base_spans(text) if _TRIGGER.search(text) else []


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: id, n_email, n_ip, n_card, n_phone (of the fixed patterns), base_sha256, spans, n_added.

    Null texts count as empty: zero counts, the digest of the empty string, no spans. Rows map one to one, so repeated ids stay;
    other columns of ``docs`` are ignored; an empty table gives an empty result. No shuffle, and memory is that of one batch.
    """
    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        crf = model()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                base = [scan(t) for t in texts]
                more = [[s for s in found if all(s[2] <= x[1] or x[2] <= s[1] for x in b)] for found, b in zip(added_spans(texts, crf), base, strict=True)]
                cols = [part.column(0)]
                cols += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                cols.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]))
                cols.append(pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()))
                cols.append(pa.array([len(m) for m in more], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
