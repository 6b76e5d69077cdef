"""The Snowball stemmer for Russian, after its published algorithm."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "аеиоуыэюя"


def _ends(*parts: str) -> tuple[str, ...]:
    return tuple(sorted(" ".join(parts).split(), key=len, reverse=True))


# The algorithm's endings; those of a first group count only after а or я.
_GERUND = _ends("в вши вшись"), _ends("ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = _ends("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_PARTICIPLE = _ends("ем нн вш ющ щ"), _ends("ивш ывш ующ")
_REFLEXIVE = _ends("ся сь")
_VERB = _ends("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"), _ends(
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
)
_NOUN = _ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
_SUPERLATIVE = _ends("ейш ейше")
_DERIVATIONAL = _ends("ост ость")


def _regions(word: str) -> tuple[int, int]:
    """Starts of the region after the first vowel and of the second region after a vowel and a consonant."""
    rv = next((i + 1 for i, c in enumerate(word) if c in _VOWELS), len(word))

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return len(word)

    return rv, after(after(0))


def _cut(word: str, start: int, endings: tuple[str, ...], after: str = "") -> str | None:
    """The word without the longest of the endings that lies in the region, or None."""
    for e in endings:
        if word.endswith(e) and len(word) - len(e) >= start:
            rest = word[: len(word) - len(e)]
            if not after or (len(rest) > start and rest[-1] in after):
                return rest
    return None


def _cut_either(word: str, start: int, groups: tuple[tuple[str, ...], tuple[str, ...]]) -> str | None:
    """As _cut over both groups, longest ending first; the first group counts after а and я."""
    for e in sorted((*groups[0], *groups[1]), key=len, reverse=True):
        got = _cut(word, start, (e,), "" if e in groups[1] else "ая")
        if got is not None:
            return got
    return None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words without Cyrillic letters stay as they are."""
    if not any("а" <= c <= "я" or c == "ё" for c in word):
        return word
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    done = _cut_either(word, rv, _GERUND)
    if done is None:
        word = _cut(word, rv, _REFLEXIVE) or word
        done = _cut(word, rv, _ADJECTIVE)
        if done is not None:
            got = _cut_either(done, rv, _PARTICIPLE)
            done = done if got is None else got
        else:
            done = _cut_either(word, rv, _VERB)
            if done is None:
                done = _cut(word, rv, _NOUN)
    word = word if done is None else done
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    got = _cut(word, max(rv, r2), _DERIVATIONAL)
    word = word if got is None else got
    if word.endswith("нн") and len(word) - 1 > rv:
        return word[:-1]
    got = _cut(word, rv, _SUPERLATIVE)
    if got is not None:
        return got[:-1] if got.endswith("нн") and len(got) - 1 > rv else got
    return word[:-1] if word.endswith("ь") and len(word) > rv else word
