"""Keyed, type-consistent surrogates that keep format, and never meet each other.

A surrogate is a permutation of the entity's own format class: each pass
shifts every letter or digit by a keyed hash of all the others, which can be
undone, so two entities of a type never get one surrogate by one draw, and the
same entity gets the same one everywhere. Given names are drawn from lists, so
they can. Draws that meet another entity are repeated (``pii.redrawn``), and
late ones take a wider format, which grows with each draw and so never runs out.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import unicodedata

# Given names by script and gender, as used for surrogates.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Beatriz", "Camille", "Carla", "Claire", "Elena", "Emma", "Frieda", "Greta", "Hanna", "Ines", "Julia", "Laura", "Lucia", "Marie", "Nina", "Olivia", "Paula", "Sophie"],
    ("latin", "m"): ["Albert", "Antoine", "Bruno", "Carlos", "Daniel", "Diego", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Javier", "Karl", "Louis", "Martin", "Nicolas", "Oscar", "Pablo", "Robert", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
}
# Titles that come before a name, with their gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f"}
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
_OF = {c: a for a in _ALPHABETS for c in a}
# Draws in the entity's own format, and from the list of given names; later ones are wider.
DRAWS, LISTED = 20, 3
_WIDER = {"card": ["0123456789"], "phone": ["0123456789"], "hex": ["0123456789abcdef"], "key": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"], "secret": ["abcdefghijklmnopqrstuvwxyz0123456789"], "email": ["abcdefghijklmnopqrstuvwxyz"]}
GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}


def _shift(key: bytes, what: str) -> int:
    return int.from_bytes(hmac.new(key, what.encode(), hashlib.blake2s).digest()[:8], "big")


_SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
_SOUND_OF = {c: a for low in _SOUNDS for a in (low, low.upper()) for c in a}


@functools.lru_cache(maxsize=1 << 16)
def _sounds(c: str) -> str:
    """Letters that can stand for ``c`` in a name: of its script, case and kind."""
    if c in _SOUND_OF or not c.isalpha():
        return _SOUND_OF.get(c, "")
    low = ord(c) & ~63
    return "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == unicodedata.category(c) and x not in _SOUND_OF)


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ")[0].lower()


def rename(word: str, key: bytes, rounds: int = 3) -> str:
    """A bijection on names of one shape: vowels stay vowels, capitals stay capitals."""
    chars = list(word)
    spots = [i for i, c in enumerate(chars) if len(_sounds(c)) > 1]
    for r in range(rounds):
        for i in spots:
            own = _sounds(chars[i])
            held, chars[i] = chars[i], "\0"
            chars[i] = own[(own.index(held) + _shift(key, f"{r}|{i}|{''.join(chars)}")) % len(own)]
    return "".join(chars)


def permute(text: str, key: bytes, keep: frozenset[int] = frozenset(), alphabet: str | None = None, rounds: int = 3) -> str:
    """A bijection on texts of one format; positions in ``keep`` and marks stay."""
    chars = list(text)
    spots = [i for i, c in enumerate(chars) if i not in keep and c in (alphabet or _OF)]
    for r in range(rounds):
        for i in spots:
            own = alphabet if alphabet else _OF[chars[i]]
            held, chars[i] = chars[i], "\0"
            seed = _shift(key, f"{r}|{i}|{''.join(chars)}")
            chars[i] = own[(own.index(held) + seed) % len(own)]
    return "".join(chars)


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` with it a valid card number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _spell(what: str, key: bytes, n: int, alphabets: list[str]) -> str:
    """``n`` characters by a keyed hash, of each alphabet in turn."""
    raw = hashlib.shake_256(key + what.encode()).digest(n)
    return "".join(alphabets[i % len(alphabets)][b % len(alphabets[i % len(alphabets)])] for i, b in enumerate(raw))


def _word(name: str, key: bytes, n: int) -> str:
    """A made-up name of ``n`` letters in the script of ``name``."""
    own = _sounds(name[0])
    script = script_of(name)
    sounds = [_SOUNDS[3], _SOUNDS[2]] if script == "cyrillic" else [own] if script != "latin" and len(own) > 1 else [_SOUNDS[1], _SOUNDS[0]]
    return _spell(name, key, n, sounds).capitalize()


def _wider(kind: str, canonical: str, key: bytes, more: int) -> str:
    """A longer entity of the type, by a keyed hash; nothing of a local part, number or secret stays."""
    if kind == "surname":
        return _word(canonical, key, len(canonical) + more)
    local, at, domain = canonical.rpartition("@") if kind == "email" else (canonical, "", "")
    new = _spell(canonical, key, len(local) + more, _WIDER[kind])
    if kind == "card" and luhn(canonical[:-1]) == int(canonical[-1]):
        return new[:-1] + str(luhn(new[:-1]))
    if kind == "phone":  # never a country code of 1, which a canonical number has not
        return "23456789"[int(new[0]) % 8] + new[1:]
    return f"AKIA{new[4:]}" if kind == "key" else new + at + domain


def _address(canonical: str, key: bytes, attempt: int = 0) -> str:
    """IPv4: public addresses stay public, others keep their network.

    From ``DRAWS`` on the others move to the largest private network, and after
    as many draws again all become IPv6 addresses: documentation or local ones.
    """
    a = [int(x) for x in canonical.split(".")]

    def public(o: list[int]) -> bool:
        return 0 < o[0] < 224 and o[0] not in (10, 127) and o[:2] not in ([192, 168], [169, 254]) and not (o[0] == 172 and 16 <= o[1] < 32) and 0 < o[3] < 255

    first = 0 if public(a) else 2
    if attempt >= 2 * DRAWS:
        tail = _spell(canonical, key, 24, ["0123456789abcdef"])
        return ":".join([*(["fd00", "0"] if first else ["2001", "db8"]), *(f"{int(tail[i : i + 4], 16):x}" for i in range(0, 24, 4))])
    if first and attempt >= DRAWS:
        return ".".join(map(str, [10, *hashlib.shake_256(key + canonical.encode()).digest(3)]))
    while True:
        for r in range(3):
            for i in range(first, 4):
                seed = _shift(key, f"{r}|{i}|{a[:i]}{a[i + 1 :]}")
                a[i] = (a[i] + seed) % 256
        if first or public(a):
            return ".".join(map(str, a))


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """Replacement of a canonical entity; ``attempt`` picks another permutation, late ones a wider format."""
    own = hmac.new(key, f"{kind}|{attempt}".encode(), hashlib.sha256).digest()
    if kind == "ip":
        return _address(canonical, own, attempt)
    if attempt >= DRAWS and kind not in ("name", "given"):
        canonical = _wider(kind, canonical, own, 4 * (attempt - DRAWS + 1))
    if kind == "card":
        body = permute(canonical[:-1], own, frozenset({0}))
        return body + (str(luhn(body)) if luhn(canonical[:-1]) == int(canonical[-1]) else permute(canonical[-1] + body, own, frozenset(range(1, len(canonical))))[0])
    if kind == "phone":
        # leading digits of area and exchange are never 0 or 1 in a number plan that says so
        keep = frozenset({0, 3}) if len(canonical) == 10 else frozenset({0})
        return permute(canonical, own, keep)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        fixed = 2 if labels[-2:-1] == ["example"] else 1
        head = f"{local}@{'.'.join(labels[:-fixed])}"
        return f"{permute(head, own)}{'.' if len(labels) > fixed else ''}{'.'.join(labels[-fixed:])}"
    if kind == "hex":
        return permute(canonical, own, alphabet="0123456789abcdef")
    if kind == "key":
        return permute(canonical, own, frozenset(range(4)))
    if kind == "name":
        names = GIVEN[GENDER[canonical]]
        order = sorted(names, key=lambda n: _shift(own, n))
        listed = order[(order.index(canonical) + 1 + _shift(own, "turn") % (len(names) - 1)) % len(names)]
        return listed if attempt < LISTED else f"{listed}-{_word(canonical, own, 2 + 2 * (attempt - LISTED + 1))}"
    if kind == "given":  # gender and name
        gender, _, name = canonical.partition(":")
        names = GIVEN.get((script_of(name), gender))
        if not names:
            return rename(name if attempt < DRAWS else _wider("surname", name, own, 4 * (attempt - DRAWS + 1)), own)
        listed = names[_shift(own, name) % len(names)]
        return listed if attempt < LISTED else f"{listed}-{_word(name, own, 2 + 2 * (attempt - LISTED + 1))}"
    if kind == "surname":
        return rename(canonical, own)
    return permute(canonical, own)
