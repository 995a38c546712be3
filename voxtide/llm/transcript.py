"""Raw transcript text into speaker label and spoken words.

One Aho-Corasick automaton finds openers of marks and speaker labels, a second
one filler forms; context rules decide what each hit is, and what is none is
left as spoken.  The decided spans are subtracted from the text as intervals.

Rules: a label counts only at the head (time marks and remarks may stand before
it) and only in brackets or followed by ':', '>' or ' -'; '*' opens a label when
one follows with ':', else a remark; two digits:two digits:two digits is a mark
of the tools, hours:minutes without brackets was spoken; a filler is a whole
piece whose letters are those of a form, any of them lengthened.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import ahocorasick

# Openers of marks with their closers, and the ways in which tools spell a cluster before its number.
CLOSERS = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*", "♪": "♪", "\x15": "\x15"}
CLUSTER_PREFIXES = ("speaker", "cluster", "spk", "s")


def fold(s: str) -> str:
    """Composed form, without case, with single spaces."""
    s = unicodedata.normalize("NFC", s).casefold()
    return " ".join(unicodedata.normalize("NFC", s).split())


def cluster_number(s: str, bare: bool = True) -> str | None:
    """'0' for 'Speaker 0', 'SPEAKER_00', 'spk0', 'S00', 'cluster-0' and, if ``bare``, '0'; else None."""
    s = fold(s)
    for p in CLUSTER_PREFIXES:
        if s.startswith(p):
            s, bare = s[len(p):].lstrip(" _-"), True
            break
    return str(int(s)) if bare and s.isascii() and s.isdigit() and len(s) < 10 else None


def _runs(s: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in s:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def _edges(s: str) -> str:
    """Without what is neither letter nor digit at both ends."""
    a, b = 0, len(s)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return s[a:b]


class Cleaner:
    """``labels``: (label, role); ``nonwords``: filler and untranscribed forms."""

    def __init__(self, labels: Iterable[tuple[str, str]], nonwords: Iterable[str]) -> None:
        self.roles = {fold(a): r for a, r in labels if a and a.strip()}
        forms = sorted({fold(f) for f in nonwords if f and f.strip()})
        self.forms: dict[str, list[list[tuple[str, int]]]] = {}
        for f in forms:
            self.forms.setdefault(f[0], []).append(_runs(f))
        self.marks = ahocorasick.Automaton()
        for c in (*CLOSERS, "&=", ":"):
            self.marks.add_word(c, (c, len(c)))
        for p in CLUSTER_PREFIXES:
            self.marks.add_word(p, ("cluster", len(p)))
        for a in self.roles:  # later words win, so a label that is also a prefix stays a label
            self.marks.add_word(a, ("label", len(a)))
        self.marks.make_automaton()
        self.fill = ahocorasick.Automaton() if forms else None
        for f in forms:
            self.fill.add_word(f, len(f))
        if forms:
            self.fill.make_automaton()
        self._known: dict[str, bool] = {}

    def is_nonword(self, core: str) -> bool:
        """Is it a form, with any of its letters lengthened?"""
        if core not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            r = _runs(core)
            self._known[core] = any(len(f) == len(r) and all(a == b and n >= m for (a, n), (b, m) in zip(r, f)) for f in self.forms.get(core[:1], ()))
        return self._known[core]

    def _named(self, s: str) -> str | None:
        """The role of a label, or '#n' for cluster n."""
        s = s.strip()
        if (r := self.roles.get(s)) is not None:
            return r
        n = cluster_number(s, bare=False)
        return None if n is None else f"#{n}"

    def _plain_label(self, s: str, at: int, hits: dict[int, int]) -> tuple[str, int, str] | None:
        """A label that begins at ``at``: what it names, where it ends, and what follows it."""
        n = hits.get(at)
        if n is None:
            return None
        end = at + n
        if (role := self.roles.get(s[at:end])) is None:
            k = end + (s[end : end + 1] in ("_", "-", " "))
            end = k
            while s[end : end + 1].isdigit():
                end += 1
            if end == k or not s[k:end].isascii() or end - k > 9:
                return None
            role = f"#{int(s[k:end])}"
        k = end + (s[end : end + 1] == " ")
        if s[k : k + 1] in (":", ">"):
            return role, k + 1, s[k]
        if k > end and s[k : k + 2] == "- ":
            return role, k + 1, "-"
        return None

    def split(self, text: str | None) -> tuple[str | None, list[str]]:
        """What the label at the head names (role, '#cluster' or None), and the spoken pieces in order."""
        if not text:
            return None, []
        s = fold(text) + " "
        opens: list[tuple[int, str]] = []
        hits: dict[int, int] = {}
        for end, (kind, n) in self.marks.iter(s):
            at = end - n + 1
            if kind == "label" or kind == "cluster":
                if n > hits.get(at, 0):
                    hits[at] = n
            else:
                opens.append((at, kind))
        cuts: list[tuple[int, int]] = []
        label, head, pos = None, True, 0

        def at_head(i: int) -> bool:
            """Nothing but cut spans, '-->', '>>' and spaces stands before i."""
            k, rest = 0, []
            for a, b in cuts:
                rest.append(s[k:a])
                k = max(k, b)
            rest.append(s[k:i])
            return not "".join(rest).replace("-->", "").replace(">>", "").strip()

        def try_plain(i: int) -> None:
            """Take a plain label that is the first thing left before position i."""
            nonlocal label, head, pos
            k = 0
            for a, b in cuts:
                if s[k:a].replace("-->", "").replace(">>", "").strip():
                    break
                k = max(k, b)
            while True:
                if s[k : k + 1] == " ":
                    k += 1
                elif s.startswith(">>", k):
                    k += 2
                elif s.startswith("-->", k):
                    k += 3
                else:
                    break
            head = False
            if k < i and (got := self._plain_label(s, k, hits)):
                label = got[0]
                cuts.append((k, got[1]))
                pos = max(pos, got[1])

        for i, c in opens:
            if i < pos:
                continue
            if head and not at_head(i) and not (c == ":" and s[i - 2 : i].isdigit() and at_head(i - 2)):
                try_plain(i)
                if i < pos:
                    continue
            if c == ":":
                a = i - 2
                if a >= pos and s[a:i].isdigit() and s[i + 1 : i + 3].isdigit() and s[i + 3 : i + 4] == ":" and s[i + 4 : i + 6].isdigit() and not s[i + 6 : i + 7].isdigit() and not s[max(a - 1, 0) : a].isdigit():
                    b = i + 6
                    if s[b : b + 1] == "." and s[b + 1 : b + 2].isdigit():
                        b += 1
                        while s[b : b + 1].isdigit():
                            b += 1
                    cuts.append((a, b))
                    pos = b
                continue
            if c == "&=":
                b = s.index(" ", i)
                cuts.append((i, b))
                pos = b
                continue
            if c == "*" and head and (got := self._plain_label(s, i + 1, hits)) and got[2] == ":":
                label, head, pos = got[0], False, got[1]
                cuts.append((i, pos))
                continue
            a = i + 1 + (c == "(" and s.startswith("((", i))
            b = s.find(CLOSERS[c], a)
            if b < 0:
                continue
            inner = s[a:b]
            # Asterisks mark a remark where they enclose it as quotes do: the first opens a piece, the second ends one.
            if c == "*" and (not inner.strip() or inner[0] == " " or inner[-1] == " " or s[i - 1 : i].isalnum() or s[b + 1 : b + 2].isalnum()):
                continue
            b += 1 + (a == i + 2 and s.startswith("))", b))
            if c in "[(<{" and (named := self._named(inner)) is not None:
                if head:
                    label, head = named, False
                    if s[b : b + 1] == ":":
                        b += 1
                else:
                    continue
            cuts.append((i, b))
            pos = b
        if head:
            try_plain(len(s))
        cuts.sort()
        spoken = self._subtract(s, cuts)
        return label, self._pieces(spoken)

    @staticmethod
    def _subtract(s: str, cuts: list[tuple[int, int]]) -> str:
        if not cuts:
            return s
        out, k = [], 0
        for a, b in cuts:
            out.append(s[k:a])
            k = max(k, b)
        out.append(s[k:])
        return " ".join(out)

    def _pieces(self, s: str) -> list[str]:
        """Pieces that hold a letter or digit, without fillers."""
        if self.fill is not None:
            s = " " + s + " "
            cuts = []
            for end, n in self.fill.iter(s):
                at = end - n + 1
                before = s[at - 1]
                if before.isalnum() and before != s[at]:  # inside a word, and no lengthened first letter
                    continue
                a, b = s.rfind(" ", 0, at) + 1, s.index(" ", end)
                if self.is_nonword(_edges(s[a:b])):
                    cuts.append((a, b))
            s = self._subtract(s, cuts)
        return [p for p in s.split() if p.isalpha() or any(c.isalnum() for c in p)]


def bare_words(pieces: list[str]) -> list[str]:
    """The pieces without punctuation at their edges."""
    return [p if p.isalnum() else _edges(p) for p in pieces]
