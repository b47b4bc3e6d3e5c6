"""Labelled documents made by rule, to train on: prose in several languages, lists, tables, junk, and mixtures.

The label of a mixture is that of the part that holds more than half of its words. Nothing here comes from a data
table; words are made of syllables, and sentences from frames of function words around them.
"""

from __future__ import annotations

import random

# Frames of function words; ~ is a content word, # a number, @ a name.
FRAMES = {
    "en": ["The ~ is ~ in the ~ of @.", "When it was ~, every ~ could be ~ by the ~.", "If you ~ a ~ with # ~, it will ~ for # minutes.", "There is no ~ that ~ and ~ at the same time.", "Some ~ prefer the ~ because it does not ~.", "“Do you know the ~ of @?” asked @ and ~.", "@ was a ~ who had ~ the ~ from @ to @ in #.", "It ~ on the ~, but not for the ~ that they ~."],
    "es": ["El ~ de @ no es ~ para la ~.", "Cada ~ tiene un ~ que ~ en el ~.", "Cuando la ~ está en @, los ~ se ~ con # ~.", "Para ~ el ~ hay que ~ una ~ de #.", "@ era un ~ muy ~ en la ~ de las ~."],
    "fr": ["Le ~ de @ est dans la ~ avec un ~.", "Il faut # ~ pour ~ les ~ du ~.", "On ne peut pas ~ le ~ quand il ~ sur la ~.", "Chaque ~ qui ~ dans le ~ est une ~.", "@ est un ~ des ~ et il ~ par le ~."],
    "de": ["Der ~ von @ ist nicht in der ~.", "Man ~ # ~ und einen ~, um die ~ zu ~.", "Wenn es ~, ist das ~ mit den ~ auf dem ~.", "Wer den ~ ~, darf das ~ aus @ ~.", "Die ~ wird von @ und einem ~ durch den ~ ~."],
    "ru": ["В ~ на ~ есть ~ и не ~.", "Если ~ и ~, то он ~ по # ~.", "Что ~ у @, как ~ из ~?", "Он ~ с ~ за # ~, но не ~."],
    "it": ["Il ~ di @ non è nella ~ con la ~.", "Per ~ un ~ che ~ si ~ # ~ del ~.", "La ~ è ~ e gli ~ sono ~ di ~."],
}
ONSETS, VOWELS, CODAS = "b br c ch d dr f fl g gr h k l m n p pl r s st t tr v w".split(), "a e i o u ea ou ai".split(), ["", "", "n", "r", "st", "m", "l", "t", "ck"]
CYRILLIC = "абвгдежзиклмнопрстуфхцчшы"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, lang: str = "en") -> str:
        if lang == "ru":
            return "".join(self.r.choice(CYRILLIC) for _ in range(self.r.randint(3, 9)))
        return "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) + self.r.choice(CODAS) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def name(self) -> str:
        return self.word().capitalize()

    def sentence(self, lang: str) -> str:
        out = []
        for c in self.r.choice(FRAMES[lang]):
            out.append(self.word(lang) if c == "~" else str(self.r.randint(1, 99)) if c == "#" else self.name() if c == "@" else c)
        return "".join(out)

    def phrase(self) -> str:
        form = self.r.random()
        words = [self.word() for _ in range(self.r.randint(1, 4))]
        if form < 0.35:
            words = [w.capitalize() for w in words]
        elif form < 0.5:
            words = [self.name(), "of", self.name()]
        return " ".join(words)

    def prose(self, n: int) -> str:
        lang, out, words = self.r.choice(list(FRAMES) + ["en"] * 3), [], 0
        while words < n:
            s = self.sentence(lang)
            out.append(s)
            words += len(s.split())
        form = self.r.random()
        if form < 0.42:
            k = self.r.randint(2, 5)
            return "\n\n".join(" ".join(out[i : i + k]) for i in range(0, len(out), k))
        if form < 0.57:
            return "\n".join(out)
        if form < 0.67:  # one line per speaker
            return "\n".join(f"{self.word()}{self.r.randint(1, 99)}: {s}" for s in out)
        if form < 0.77:  # bulleted sentences
            return "\n".join(f"- {s}" for s in out)
        if form < 0.95:  # without stops
            return " ".join(s.strip(".?”“").lower() for s in out)
        words = " ".join(out).split()  # wrapped at a width
        return "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))

    def list(self, n: int) -> str:
        form, out, words = self.r.choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9)), [], 0
        if form == 7:  # runs of items within lines
            lines = []
            while words < n:
                items = [self.phrase() + (f" ({self.r.randint(1, 99)})" if self.r.random() < 0.4 else "") for _ in range(self.r.randint(4, 12))]
                lines.append(self.r.choice((", ", " • ", "; ")).join(items))
                words += len(lines[-1].split())
            return "\n".join(lines)
        mark = self.r.choice(("- ", "* ", "• ", "– ", "+ "))
        tail = self.r.random()
        while words < n:
            k, item = len(out) + 1, self.phrase()
            if tail < 0.2:
                item += f" ({self.phrase()})"
            elif tail < 0.35:
                item += f" x{self.r.randint(1, 99)}"
            elif tail < 0.42:
                item = f"{self.r.randint(1, 99)} x {item}"
            lead = (f"{k}. ", f"{k}) ", f"({k}) ", f"#{k} ", mark, mark, self.r.choice(("[ ] ", "[x] ")), "", "" if self.r.random() < 0.6 else mark, "")[form]
            out.append(lead + item)
            words += len(out[-1].split())
        return "\n".join(out)

    def cell(self) -> str:
        return self.r.choice((str(self.r.randint(1, 99)), f"{self.r.randint(1, 99)}%", f"{self.r.random() * 10:.2f}", self.word(), "—", self.name()))

    def table(self, n: int) -> str:
        form, out, words, cols = self.r.randrange(7), [], 0, self.r.randint(2, 6)
        while words < n:
            cells = [self.phrase() if self.r.random() < 0.8 else self.name(), *(self.cell() for _ in range(cols))]
            if form == 0:
                line = "| " + " | ".join(cells) + " |"
            elif form == 1:
                line = "|-\n| " + " || ".join(cells)
            elif form == 2:
                line = "\t".join(cells)
            elif form == 3:
                line = ",".join(cells)
            elif form == 4:
                line = " ; ".join(cells)
            elif form == 5:
                line = "".join(c.ljust(20) for c in cells).rstrip()
            else:
                line = f"{' '.join(self.word() for _ in range(self.r.randint(1, 2))).capitalize()}{self.r.choice((': ', ': ', ' = '))}{self.cell()}{self.r.choice(('', ' HP'))}"
            out.append(line)
            words += len(line.split())
        return "\n".join(out)

    def junk(self, n: int) -> str:
        form, r = self.r.randrange(9), self.r
        chars = "abcdefghijklmnopqrstuvwxyz"
        tokens: list[str] = []
        if form == 0:  # machine strings
            pool = r.choice(("0123456789abcdef", chars + chars.upper() + "0123456789+/"))
            tokens = ["".join(r.choice(pool) for _ in range(r.randint(2, 50))) for _ in range(n)]
        elif form == 1:
            tokens = ["".join(r.choice(chars) for _ in range(r.randint(3, 12))) for _ in range(n)]
        elif form == 2:  # one or two strings again and again
            pool = [self.word() + str(r.randint(1, 999)) for _ in range(r.randint(1, 3))]
            tokens = [r.choice(pool) for _ in range(n)]
        elif form == 3:  # words without any sentence
            pool = [self.word() for _ in range(60)]
            tokens = [r.choice(pool) if r.random() < 0.9 else self.name() for _ in range(n)]
        elif form == 4:  # damaged encoding
            tokens = ["".join(r.choice(("Ã©", "Ã¼", "â€™", "â€œ", "Ð¾", "Â°", "ï¿½", "Ã±", "Å¡", r.choice(chars))) for _ in range(r.randint(2, 6))) for _ in range(n)]
        elif form == 5:
            tokens = ["".join(r.choice("!@$%^&*_+=<>?/\\~.:;#-") for _ in range(r.randint(1, 10))) if r.random() < 0.85 else self.name() for _ in range(n)]
        elif form == 6:  # leavings of templates and errors
            while len(tokens) < n:
                tokens += r.choice(("&nbsp;&#{};", "style=width:{}px;", "Lua error in Module:X at line {}: nil", "<td class=\"c{}\"> </td>", "}} a= {}px", "<ref id=\"b{}\">", "0x{} Traceback at .py:1:", "{}% <br/>")).format(r.randint(1, 9999)).split()
        elif form == 7:
            tokens = [str(r.randint(0, 10 ** r.randint(1, 9))) for _ in range(n)]
        else:
            pool = "".join(chr(c) for c in range(0x21, 0x7F))
            tokens = ["".join(r.choice(pool) for _ in range(r.randint(2, 14))) for _ in range(n)]
        if r.random() < 0.35:  # broken into lines
            k = r.randint(3, 14)
            return "\n".join(" ".join(tokens[i : i + k]) for i in range(0, len(tokens), k))
        return " ".join(tokens)


def labelled_documents(n: int, seed: int = 11) -> list[tuple[str, str]]:
    """n pairs (text, label): prose, list, table or junk."""
    m = Maker(seed)
    out = []
    for _ in range(n):
        total = int(m.r.lognormvariate(4.3, 0.7)) + 12
        kind = m.r.choices(("prose", "list", "table", "junk", "mixed"), (25, 15, 15, 15, 30))[0]
        if kind != "mixed":
            text = getattr(m, kind)(total)
            if kind != "prose" and m.r.random() < 0.4:  # a sentence before
                lead = m.sentence("en")
                if len(lead.split()) * 2.5 < len(text.split()):
                    text = f"{lead}\n{text}"
            if kind == "prose" and m.r.random() < 0.3:
                text = f"== {m.name()} ==\n\n{text}"
        else:
            other = m.r.choice(("list", "table", "list", "table", "junk"))
            share = m.r.choice((0.2, 0.3, 0.38, 0.45, 0.55, 0.62, 0.7, 0.8))
            a, b = m.prose(max(5, int(total * (1 - share)))), getattr(m, other)(max(5, int(total * share)))
            own = len(b.split()) / (len(a.split()) + len(b.split()))
            if 0.48 < own < 0.52:
                continue
            kind = other if own > 0.5 else "prose"
            text = "\n\n".join((a, b) if m.r.random() < 0.7 else (b, a))
        out.append((text, kind))
    return out
