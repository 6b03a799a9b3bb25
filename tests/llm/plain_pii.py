"""Personal data replaced text by text in plain Python, to hold the operator against."""

import hashlib

import regex

from tidewater.llm import pii

ENTITY, WORD, HINT = regex.compile(pii.ENTITY), regex.compile(f"{pii.ENTITY}|{pii.WORD}"), regex.compile(pii.HINT)
KINDS = {kind: regex.compile(p) for kind, p in pii.PATTERNS.items()}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def kind_of(mention):
    return next((k for k, p in KINDS.items() if k != "name" and p.fullmatch(mention)), "name")


def body_of(mention, kind):
    if kind == "secret":
        return regex.sub(rf"\A(?:{pii._LABEL}|{pii._LABEL_DIGIT}|AKIA|gh[pousr]_|sk-)", "", mention)
    return regex.sub(rf"\A{pii._TITLES}", "", mention) if kind == "name" else mention


def name_words(body):
    return [w for w in body.split(" ") if w not in pii.PARTICLES]


def parts_of(kind, mention, body):
    if kind == "name":
        title = mention[: len(mention) - len(body)]
        said = [g for g, titles in (("m", pii.MALE), ("f", pii.FEMALE)) if regex.search(rf"(?<!\p{{L}})(?:{'|'.join(titles)})[. ]", title)]
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", body) else "latin"
        *given, family = name_words(body)
        return [(f"given_{[*said, 'n'][0]}_{script}", w.lower()) for w in given] + [(f"family_{script}", family.lower())]
    if kind in ("card", "ssn", "phone"):
        return [(kind, regex.sub("[^0-9]", "", body))]
    return [(kind, body.lower() if kind == "email" else regex.sub("[ -]", "", body) if kind == "iban" else body)]


def surrogate(kind, text, draw):
    bytes_ = b"".join(hashlib.sha512("\u0001".join([pii.KEY, kind, text, str(draw), str(b)]).encode()).digest() for b in range(len(text) // 60 + 2))
    hexadecimal = regex.fullmatch("[0-9a-f]+|[0-9A-Fa-f]{32,}", text)

    def spelt(kept):
        out = ""
        for i, c in enumerate(text):
            for pattern, letters in (("[0-9]", "0123456789"), ("[a-z]", "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{Cyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")):
                if i >= kept and regex.match(pattern, c):
                    c = letters[bytes_[i] % len(letters)]
                    break
            out += c
        return out

    tail = str(bytes_[0] % 10) if draw >= pii.DRAWS_IN_FORMAT else ""
    if kind == "email":
        user, domain = text.split("@")[0], text.split("@")[-1]
        top = regex.search(r"\.\p{L}+\Z", domain)[0]
        return spelt(0)[: len(user)] + tail + "@" + spelt(0)[len(user) + 1 :][: len(domain) - len(top)] + top
    if kind == "ip":
        return ".".join(str(b % 254 + 1) for b in bytes_[:4])
    if kind == "card":
        start = spelt(1)[:-1]
        return start + next(d for d in "0123456789" if luhn(start + d))
    if kind == "iban":
        return spelt(2) + tail
    if kind == "phone":
        return spelt(max(len(text) - 10, 0)) + tail
    if kind.startswith(("family", "given")):
        syllables = pii.SYLLABLES[kind.rsplit("_", 1)[1]]
        family = "".join(syllables[b % len(syllables)] for b in bytes_[: draw + 3]).capitalize()
        if kind.startswith("family"):
            return family
        names = pii.GIVEN[kind]
        return names[bytes_[0] % len(names)] + (f"-{family}" if draw else "")
    return spelt(0) + tail


def assigned(entities):
    settled, waiting, draw = {}, set(entities), 0
    while waiting:
        taken, wanted = set(entities) | {(k, s) for (k, _), s in settled.items()}, {}
        for kind, text in sorted(waiting):
            wanted.setdefault((kind, surrogate(kind, text, draw)), text)
        good = {(kind, text): s for (kind, s), text in wanted.items() if (kind, s) not in taken}
        settled |= good
        waiting, draw = waiting - set(good), draw + 1
    return settled


def cased(word, one):
    return one.upper() if word == word.upper() else one


def replaced(texts):
    """The texts with surrogates."""
    found = [{m for m in ENTITY.findall(t)} if t and HINT.search(t) else set() for t in texts]
    known = {}
    for mention in set().union(*found):
        kind = kind_of(mention)
        body = body_of(mention, kind)
        if kind != "card" or luhn(regex.sub("[^0-9]", "", body)):
            known[mention] = (kind, body, parts_of(kind, mention, body))
    chosen = assigned({p for _, _, ps in known.values() for p in ps})
    new = {}
    for mention, (kind, body, parts) in known.items():
        ones = [chosen[p] for p in parts]
        out = ones[0]
        if kind == "name":
            out = " ".join(map(cased, name_words(body), ones))
        elif kind in ("card", "ssn", "phone", "iban"):
            left = list(regex.sub("[^A-Za-z0-9]", "", ones[0]))
            out = "".join((left.pop(0) if left else "") if regex.match("[A-Za-z0-9]", c) else c for c in body) + "".join(left)
        new[mention] = mention[: len(mention) - len(body)] + out
    result = []
    for text, mentions in zip(texts, found, strict=True):
        words = {}
        for m in mentions:
            if m in known and known[m][0] == "name":
                for p in known[m][2]:
                    words[p[1]] = min(words.get(p[1], ("~", "")), (p[0], chosen[p]))

        def word(w, words=words):
            return cased(w, words[w.lower()][1]) if w.lower() in words else w

        def change(m, words=words, word=word):
            if m[0] in new:
                return new[m[0]]
            return word(m[0]) if m[0].lower() in words else "".join(map(word, regex.split(r"([’'-])", m[0])))

        result.append((WORD if words else ENTITY).sub(change, text) if any(m in new for m in mentions) else text)
    return result
