"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of letters and digits (some of each or of a known form), a value that is assigned to a name
of secrets or said to be one ("the password is .."), each word of such a value in quotes (of ``QUOTED_WORDS`` words at most), the password in an address, or
what stands behind "Authorization: Basic"; a word can hold many, and each is scored with the part of the word it stands in. Its features are its length, shares of character classes, transitions between classes,
coverage by the words of a vocabulary, whether it looks like a path, address, placeholder or code, and what its neighbouring words say. The
forest is grown in numpy from labelled findings (``labelled_findings``: a seeded list of secrets and of what is taken
for them, with words around them), whose features are found by the same expressions, and is then an expression itself:
scanning is one projection of the documents, with no shuffle and no Python on the executors.

Defined cases: a null or blank text has no findings; a null ``doc_id`` keeps its findings; repeated rows have theirs
each; an empty table gives no rows; other columns are kept by ``scanned``.
"""

from __future__ import annotations

import base64
import json
import random
import re
import string
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import SPACE_RUN, table, text_or_empty
from folio.llm.fingerprints import bound
from folio.llm.mixing import literal_table

SEED = 404
TREES, DEPTH, LEAST_LEAF = 15, 8, 5
FINDINGS = 4000
LIMIT = 0.5
MARK = "[SECRET]"

#: Names that secrets are assigned to, and words that stand before what is no secret.
NAMES = "(?:secret|auth|private|refresh|access|session)[_-]?(?:key|token|secret)|password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private|client[_-]?key|signing[_-]?key"
NO_SECRET = "sha|md5|commit|checksum|digest|uuid|guid|hash|etag|revision|build|serial|isbn|order|invoice|phone|card|account|version|id"
#: Beginnings of well-known kinds of secrets.
FORMS = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^glpat-|^xox[abprs]-|^sk[-_](?:live|test)?|^AIza|^eyJ|^npm_|^SG\."
#: Words of the vocabulary that coverage is measured with: its first ones of so many letters, as frequent words come first.
VOCABULARY, DICTIONARY_WORDS, WORD_LETTERS = "word_bpe_49k.json", 1500, (3, 9)

LONG = r"(?<![A-Za-z0-9+/_.\-])([A-Za-z0-9+/_.\-]{16,}={0,2})"
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?[=:]+[\"']?([^\s\"',;&<>]{{6,}})"
#: As ASSIGNED, but the value is only looked at, so that one inside it is found too.
EACH_ASSIGNED = rf"(?i)(?:{NAMES})[\"']?[=:]+[\"']?(?=([^\s\"',;&<>]{{6,}}))"
#: From where on a value is the next assignment.
NEXT_ASSIGNED = rf"(?i)[^A-Za-z0-9](?:{NAMES})[\"']?[=:].*$"
#: A password in an address, between a name and a host.
IN_ADDRESS = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]*:([^\s/@]{3,})@[^\s@]"
#: A name of secrets whose value begins with a quote: anywhere in a text, with the quote open at the end of a word, and of some words.
QUOTE = rf"(?i)(?:{NAMES})[\"']?\s*[:=]+\s*[\"']"
OPEN_IN_WORD = rf"(?i)(?:{NAMES})[\"']?[:=]+[\"']([^\"']+)$"
OPEN_BEFORE = rf"(?i)(?:{NAMES})[\"']?\s*[:=]+\s*[\"'][^\"']*$"
QUOTED_WORDS = 8
#: Words before a value that say it is one: a name of secrets and a verb, or a scheme of authorization.
SAID = rf"(?i)(?:{NAMES})\s+(?:is|was)$"
SCHEME = r"(?i)authorization[\"']?\s*[:=]\s*[\"']?(?:basic|bearer|digest|token)$"
#: What stands in place of a value, and code that finds it.
PLACEHOLDER = r"(?i)change[_-]?me|example|dummy|sample|placeholder|xxx|\*\*\*|your|here$|^test|^enter|^insert|^<|^null$|^none$|^true$|^false$|^string$|^required$|^optional$|^undefined$|^boolean$|^redacted|^hidden|^password$|^secret$"
CODE = r"^[$%]\{?[A-Za-z_]+\}?%?$|\w\(|\w\[|\{\{|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$"
#: Between the parts of a word.
PARTS = r"[?&|,;]+(?=.)"
HAS_NAME = rf"(?i)(?:{NAMES})"
FEATURES = ("length", "digits", "upper", "lower", "transitions", "dictionary", "path", "named", "no_secret", "hex", "uuid", "form", "assigned", "placeholder", "one_word", "code", "in_address", "said", "quoted")


@lru_cache(maxsize=4)
def ordinary_words(path: str | None = None) -> tuple[str, ...]:
    """Whole words of a vocabulary, frequent ones first."""
    ids = json.loads(Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8"))["model"]["vocab"]
    low, high = WORD_LETTERS
    whole = re.compile(rf"([a-z]{{{low},{high}}})</w>")
    return tuple([m[1] for t in sorted(ids, key=ids.get) if (m := whole.fullmatch(t))][:DICTIONARY_WORDS])


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> str:
    """A pattern of ordinary words, of those with the same beginning the long ones first; by their first two letters, so few are tried at a place."""
    by_letters: dict[str, dict[str, list[str]]] = {}
    for w in sorted(ordinary_words(path), key=lambda w: (-len(w), w)):
        by_letters.setdefault(w[0], {}).setdefault(w[1], []).append(w[2:])
    second = lambda words: "|".join(f"{b}(?:{'|'.join(words[b])})" for b in sorted(words))
    return "|".join(f"{a}(?:{second(by_letters[a])})" for a in sorted(by_letters))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.char_length(value), F.lit(1))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def features(word: Column, value: Column, near: Column, phrase: Column) -> dict[str, Column]:
    """word: the word or part of a word; value: the candidate in it; near: the three words before; phrase: all words of a value in quotes, else empty."""
    low = F.lower(value)
    return {
        "length": F.char_length(value).cast("double"),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "lower": _share(value, "[a-z]"),
        "transitions": _share(value, r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "dictionary": 1 - F.char_length(F.regexp_replace(low, dictionary(), "")) / F.greatest(F.char_length(value), F.lit(1)),
        "path": _flag(word.rlike(r"://|^[./~]|\.[a-z]{2,4}$|/[^/]+/|\\")),
        "named": _flag(near.rlike(HAS_NAME) | word.rlike(HAS_NAME)),
        "no_secret": _flag(near.rlike(rf"(?i)\b(?:{NO_SECRET})\b|(?i)\b(?:sha|md5)") | word.rlike(r"(?i)^(?:sha\d*|md5|id|uuid|commit)[:=]")),
        "hex": _flag(value.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$")),
        "uuid": _flag(value.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        "form": _flag(value.rlike(FORMS)),
        "assigned": _flag(word.rlike(ASSIGNED) | near.rlike(rf"(?i)(?:{NAMES})[\"']?\s*[:=]+$")),
        "placeholder": _flag(value.rlike(PLACEHOLDER) | phrase.rlike(PLACEHOLDER)),
        "one_word": _flag(low.rlike(rf"^(?:{dictionary()})$")),
        "code": _flag(value.rlike(CODE)),
        "in_address": _flag(word.rlike(IN_ADDRESS)),
        "said": _flag(near.rlike(SAID) | near.rlike(SCHEME)),
        "quoted": _flag(phrase != ""),
    }


def kind(word: Column, value: Column) -> Column:
    known = [(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", "access_key_id"), (r"^gh[pousr]_|^glpat-", "repository_token"), (r"^xox", "chat_token"), (r"^eyJ", "signed_token")]
    out = F.when(word.rlike(r"(?i)pass|pwd"), "password")
    for pattern, name in known:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("token")


def candidates(text: Column) -> Column:
    """An array of (at, word, value, kind, features..) of all candidates of a text; ``at`` counts words from 0."""

    def of(text_: Column) -> Column:
        w, has_quotes = text_["w"], text_["q"]

        def before(i: Column, k: int) -> Column:
            return F.when(i >= k, F.get(w, i - k)).otherwise("")

        def is_behind(i: Column) -> Column:
            x, last = F.get(w, i), before(i, 1)
            return (F.octet_length(x) >= 6) & (last.endswith("=") | last.endswith(":")) & F.concat_ws(" ", before(i, 2), last).rlike(rf"(?i)(?:{NAMES})[\"']?\s*[:=]+$")

        def some_before(i: Column, k: int) -> Column:
            return F.concat_ws(" ", *[before(i, j) for j in range(k, 0, -1)])

        def phrase(i: Column) -> Column:
            """The words around, if the word is one of some in quotes that a name of secrets stands before; else empty."""
            x = F.get(w, i)
            end = F.regexp_extract(F.array_join(F.slice(w, i + 2, QUOTED_WORDS), " "), r"^([^\"']*)[\"']", 1)
            opens = F.regexp_extract(x, OPEN_IN_WORD, 1)
            inside = F.regexp_extract(F.concat_ws(" ", some_before(i, QUOTED_WORDS), F.regexp_replace(x, r"[\"'].*$", "")), OPEN_BEFORE, 0)
            starts = F.when(before(i, 1).rlike(r"[:=]$") & x.rlike(r"^[\"'][^\"']+$"), F.regexp_extract(F.concat_ws(" ", before(i, 2), before(i, 1), x), OPEN_BEFORE, 0)).otherwise("")
            found = (
                F.when((opens != "") & (end != ""), F.concat_ws(" ", opens, end))
                .when((starts != "") & (end != ""), F.concat_ws(" ", F.regexp_replace(x, r"^[\"']", ""), end))
                .when((inside != "") & (x.rlike(r"^[^\"']+[\"']") | ((end != "") & ~x.rlike(r"[\"']"))), F.concat_ws(" ", F.regexp_replace(inside, QUOTE, ""), end))
            )
            return F.when(has_quotes, F.coalesce(F.trim(found), F.lit(""))).otherwise("")

        def is_said(i: Column) -> Column:
            x, near = F.get(w, i), F.concat_ws(" ", before(i, 2), before(i, 1))
            said = F.lower(before(i, 1)).isin("is", "was") & near.rlike(SAID) & (x.rlike("[0-9]") | x.rlike(r"^[\"'][^\"']+[\"']"))
            return (F.octet_length(x) >= 6) & (said | (F.lower(before(i, 1)).isin("basic", "bearer", "digest", "token") & near.rlike(SCHEME)))

        def is_candidate(i: Column) -> Column:
            x = F.get(w, i)
            address = (F.octet_length(x) >= 10) & x.contains("://") & x.contains("@") & x.rlike(IN_ADDRESS)
            long_ = (F.octet_length(x) >= 16) & x.rlike(LONG) & (x.rlike("[0-9]") | F.exists(F.regexp_extract_all(x, F.lit(LONG), F.lit(1)), lambda v: v.rlike(FORMS)))
            assigned = (F.octet_length(x) >= 10) & x.rlike(ASSIGNED)
            return long_ | assigned | is_behind(i) | address | is_said(i) | (has_quotes & (phrase(i) != ""))

        def values(word: Column, parts: Column, behind: Column, quoted: Column) -> Column:
            """All candidates of a word, each once."""
            none = F.array().cast("array<string>")
            assigned = F.regexp_extract_all(word, F.lit(EACH_ASSIGNED), F.lit(1))
            cut = F.transform(F.filter(assigned, lambda v: v.rlike(NEXT_ASSIGNED)), lambda v: F.regexp_replace(v, NEXT_ASSIGNED, ""))
            long_ = F.filter(F.regexp_extract_all(word, F.lit(LONG), F.lit(1)), lambda v: word.rlike("[0-9]") | v.rlike(FORMS))
            head = F.when(behind & (F.size(parts) > 1), F.array(F.regexp_replace(F.get(parts, 0), r"^[\"'(\[{]+|[\"')\]}]+$", ""))).otherwise(none)
            whole = F.filter(F.array(F.regexp_extract(word, r"^[\"']([^\"']{6,})[\"']", 1)), lambda v: behind & (v != ""))
            address = F.filter(F.regexp_extract_all(word, F.lit(IN_ADDRESS), F.lit(1)), lambda v: word.contains("@"))
            found = F.concat(assigned, whole, address, long_, F.filter(F.concat(cut, head), lambda v: F.char_length(v) >= 6))
            piece = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, rf"(?i)^.*(?:{NAMES})[\"']?[:=]+[\"']", ""), r"^[\"']", ""), r"[\"'].*$", "")
            found = F.when(quoted & (piece != ""), F.array(piece)).otherwise(found)
            bare = F.regexp_replace(word, r"^[\"'(\[]+|[\"')\],;#.]+$", "")
            found = bound(found, lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(F.coalesce(F.nullif(F.regexp_extract(word, LONG, 1), F.lit("")), bare))))
            return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, r"[.\-]+$", "")))

        def found(i: Column) -> Column:
            word, near = F.get(w, i), F.concat_ws(" ", before(i, 3), before(i, 2), before(i, 1))

            def of_parts(parts: Column) -> Column:
                def part(value: Column) -> Column:
                    mine = F.filter(parts, lambda p: p.contains(value))
                    return F.coalesce(F.get(F.filter(mine, lambda p: p.rlike(ASSIGNED)), 0), F.get(mine, 0), word)

                of_phrase = lambda p: F.transform(values(word, parts, is_behind(i) | is_said(i), p != ""), lambda v: F.struct(i.alias("at"), part(v).alias("word"), v.alias("value"), near.alias("near"), p.alias("phrase")))
                return bound(phrase(i), of_phrase)

            return bound(F.split(word, PARTS), of_parts)

        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), is_candidate)
        raw = F.when(F.size(w) == 0, F.array().cast("array<struct<at:int,word:string,value:string,near:string,phrase:string>>")).otherwise(F.flatten(F.transform(at, found)))
        return F.transform(raw, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), kind(c["word"], c["value"]).alias("kind"), *[v.alias(k) for k, v in features(c["word"], c["value"], c["near"], c["phrase"]).items()]))

    return bound(F.struct(F.filter(F.split(text, SPACE_RUN), lambda x: x != "").alias("w"), text.rlike(QUOTE).alias("q")), of)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int]]:
    """Short texts with one candidate each, and whether that is a secret."""
    rng = random.Random(seed)
    letters, digits, hexes = string.ascii_letters, string.digits, "0123456789abcdef"
    take = lambda signs, k: "".join(rng.choice(signs) for _ in range(k))
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "der", "sch", "que", "ent", "les", "ion", "ado", "ci"]
    prose = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))
    name = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "SECRET_KEY", "API_TOKEN", "credential"])
    after = lambda: rng.choice(["", "", "", ",", ".", "###", "$$$", "***", "%%%", ";"])

    ordinary = sorted(ordinary_words(), key=lambda w: (-len(w), w))
    # ordinary words, and made-up ones of other languages
    word = lambda: rng.choice(ordinary) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    sign = lambda: rng.choice("!@#&*_-.")

    def chosen() -> str:
        """A password as people choose it, of words mostly; 10 letters or more, or some digits in it."""
        w = word()
        out = rng.choice([
            lambda: "".join(word() for _ in range(rng.randint(3, 4))), lambda: f"{w}{rng.randint(1, 99)}" * 2, lambda: f"{w}{rng.randint(1, 999)}{word()}", lambda: f"{w.capitalize()}{sign()}{take(digits, rng.randint(2, 4))}", lambda: take(string.ascii_lowercase, rng.randint(12, 20)),
            lambda: f"{w.capitalize()}{word()}".replace("o", "0").replace("e", "3").replace("a", "4") + sign() + take(digits + letters, 2), lambda: f"{w}{sign()}{word()}{sign()}{word()}", lambda: f"{w}{take(digits, rng.randint(3, 6))}",
        ])()
        return out if len(out) >= 10 else out + take(digits, 4)

    def placeholder() -> str:
        return rng.choice(["changeme", "example", "dummy", "xxxxxxxx", "********", "test1234", "required", "optional", "string", "undefined", "placeholder", "password", f"your_{word()}_here", f"your-{word()}", f"example{word()}{rng.randint(1, 99)}"])

    def address(value: str) -> str:
        return f"{rng.choice(['postgres', 'mysql', 'redis', 'amqp', 'https', 'mongodb+srv', 'ftp'])}://{rng.choice(['admin', 'root', 'user', word()])}:{value}@{word()}.{rng.choice(['host', 'com', 'local', 'net'])}{rng.choice(['', ':5432', ':6379'])}{rng.choice(['', '/' + word()])}"

    def secret() -> str:
        if rng.random() < 0.4:
            c = chosen()
            return rng.choice([
                lambda: f"{name()}={c}", lambda: f"{name()}: {c}", lambda: f'{name()} = "{c}"', lambda: f"{name()} = {c}", lambda: f"{name()}='{c}';{name()}={take(letters + digits, 20)}", lambda: f'my {rng.choice(["password", "passphrase", "secret"])} {rng.choice(["is", "was"])} "{c}"', lambda: f"{rng.choice(['password', 'pwd'])} is {word()}{take(digits, 3)}{word()}",
                lambda: f'{name()}="{" ".join(word() for _ in range(rng.randint(1, 4)))} {c}"', lambda: f'{name()}: "{c} {word()} {word()}"', lambda: address(c), lambda: address(c), lambda: address(take(letters + digits, rng.randint(8, 20))),
                lambda: f"Authorization: Basic {base64.b64encode(f'{word()}:{c}'.encode()).decode()}", lambda: f"Authorization: Bearer {take(letters + digits, 24)}",
            ])()
        value = rng.choice([
            lambda: take(hexes, rng.choice([18, 20, 24, 32, 40, 64])), lambda: take(letters + digits, rng.randint(16, 44)),
            lambda: take(letters + digits + "+/", rng.choice([32, 40, 44])) + rng.choice(["", "="]), lambda: take(letters, 4) + take(digits, 4) + take(letters + digits, 8), lambda: take(letters + digits + "!@$%^*_-", rng.randint(12, 24)), lambda: take(digits + digits + hexes, rng.choice([16, 18, 24])) + rng.choice("abcdef") + take(digits, 2),
        ])()
        return rng.choice([
            lambda: rng.choice(["AKIA", "AKIA", "ASIA"]) + take(string.ascii_uppercase + rng.choice([digits, ""]), 16), lambda: f"{name()}={value}", lambda: f'{name()} = "{value}"', lambda: f"{name()}: {value}", lambda: f"{name()}='{value}'",
            lambda: f"bearer {value}", lambda: rng.choice(["ghp_", "gho_", "xoxb-", "sk-", "AIza", "glpat-", "npm_"]) + take(letters + digits, 34) + "1", lambda: "eyJ" + take(letters + digits, 30) + "1." + take(letters + digits, 40),
        ])()

    def other() -> str:
        if rng.random() < 0.3:
            return rng.choice([
                lambda: f"{name()}: {rng.choice(ordinary)}", lambda: f"{name()} = {rng.choice(ordinary)}", lambda: f"{name()}={placeholder()}", lambda: f"{name()}: {placeholder()}", lambda: f"{name()} = get{word().capitalize()}{word().capitalize()}()", lambda: f"{name()}=${{{word().upper()}_{word().upper()}}}", lambda: f"{name()} = {word()}.{word()}.{word()}", lambda: f"{name()}={word()}[{word()}]",
                lambda: f'{name()}: "{rng.choice(["enter", "insert"])} your {word()} here"', lambda: f'{name()}="your {word()} {word()}"', lambda: address(placeholder()), lambda: f"https://{word()}.com:8080/@{word()}/{word()}{rng.randint(1, 99)}", lambda: f"basic {word()}{word()}{word()}{rng.randint(1, 9)}", lambda: f'the {rng.choice(["password", "secret"])} is "{rng.choice(ordinary)}"', lambda: f"the {rng.choice(['token', 'secret'])} was {word()}-{rng.randint(1, 9)}-{word()}",
            ])()
        return rng.choice([
            lambda: f"{rng.choice(['sha1', 'md5', 'checksum', 'commit', 'digest', 'etag', 'revision', 'sha256'])} {take(hexes, rng.choice([32, 40, 64]))}", lambda: f"sha256:{take(hexes, 64)}",
            lambda: f"{rng.choice(['id', 'uuid', 'see', 'of'])} {take(hexes, 8)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 12)}", lambda: take(digits, rng.randint(16, 19)), lambda: f"card {take(digits, 16)}",
            lambda: f"/{word()}/{word()}/{word()}{rng.randint(1, 99)}.{rng.choice(['txt', 'png', 'py', 'html'])}", lambda: f"https://{word()}.com/{word()}/{rng.randint(1, 9999)}/{word()}", lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 2030)}",
            lambda: f"{word()}{''.join(word().capitalize() for _ in range(rng.randint(2, 5)))}{rng.randint(1, 99)}{rng.choice(['', word().capitalize()])}", lambda: f"{''.join(word().capitalize() for _ in range(rng.randint(3, 6)))}{rng.randint(1, 9)}", lambda: f"{word()}{word().capitalize()}{rng.randint(1, 99)}{word().capitalize()}{word().capitalize()}()", lambda: f"{word()}.{word()}.{word()}{rng.randint(1, 9)}", lambda: f"{name()}=your_{word()}_here1", lambda: f"{name()}: example{word()}{rng.randint(1, 99)}", lambda: f"{name()}={rng.choice(['changeme', 'example', 'dummy', 'xxxxxxxx', '********', 'test1234'])}",
            lambda: f"20{take(digits, 2)}-{take(digits, 2)}-{take(digits, 2)}T{take(digits, 2)}-{take(digits, 2)}-{take(digits, 2)}", lambda: f"{word()}{word()}{word()}_{rng.randint(1, 9)}_{word()}", lambda: f"version-{rng.randint(1, 9)}.{rng.randint(1, 20)}.{rng.randint(1, 99)}-{word()}{rng.randint(1, 9)}",
            lambda: f"the secret of {word()}{word()}{word()}{word()}{rng.randint(1, 9)}", lambda: f"order {take(string.ascii_uppercase, 3)}-{take(digits, 6)}-{take(digits, 6)}",
        ])()

    out = []
    for i in range(n):
        y = int(i % 2 == 0)
        out.append((f"{prose(rng.randint(0, 6))} {secret() if y else other()}{after()} {prose(rng.randint(0, 4))}", y))
    return out


class Tree:
    """A node: a leaf with its share of secrets, or a question with two nodes."""

    def __init__(self, share: float, feature: int = -1, limit: float = 0.0, low: Tree | None = None, high: Tree | None = None):
        self.share, self.feature, self.limit, self.low, self.high = share, feature, limit, low, high

    def column(self, value) -> Column:
        if self.feature < 0:
            return F.lit(float(self.share))
        return F.when(value(self.feature) <= F.lit(float(self.limit)), self.low.column(value)).otherwise(self.high.column(value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        return np.where(x[:, self.feature] <= self.limit, self.low.predict(x), self.high.predict(x))


def grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
        return Tree(share)
    best = (1e-9, -1, 0.0)
    n, total = len(y), y.sum()
    gini = 2 * share * (1 - share)
    for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, positive = x[order, f], np.cumsum(y[order])
        left = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (left >= LEAST_LEAF) & (n - left >= LEAST_LEAF)
        if ok.any():
            a, b = positive[:-1] / left, (total - positive[:-1]) / (n - left)
            gain = np.where(ok, gini - (left * 2 * a * (1 - a) + (n - left) * 2 * b * (1 - b)) / n, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(f), float(v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return Tree(share)
    low = x[:, best[1]] <= best[2]
    return Tree(share, best[1], best[2], grown(x[low], y[low], rng, depth - 1), grown(x[~low], y[~low], rng, depth - 1))


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [grown(x[k], y[k], rng, depth) for k in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def feature_rows(spark: SparkSession, findings: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the first candidates in labelled texts."""
    rows = literal_table(spark, [{"t": t, "y": y} for t, y in findings], "t string, y int").select("y", F.explode(F.slice(candidates(F.col("t")), 1, 1)).alias("c")).select("y", *[F.col(f"c.{f}") for f in FEATURES]).collect()
    return np.array([[float(r[f]) for f in FEATURES] for r in rows]), np.array([float(r["y"]) for r in rows])


def trained(spark: SparkSession) -> list[Tree]:
    return forest(*feature_rows(spark, labelled_findings()))


def scanned(docs: DataFrame, trees: list[Tree], limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` with ``findings``: (at, value, kind, score) of what the forest takes for a secret."""

    def scored(c: Column) -> Column:
        votes = [t.column(lambda f: c[FEATURES[f]]) for t in trees]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return F.struct(c["at"], c["value"], c["kind"], (total / len(trees)).alias("score"))

    # a finding inside another one of its word is that one's
    def widest(f: Column) -> Column:
        return F.filter(f, lambda c: ~F.exists(f, lambda d: (d["at"] == c["at"]) & (d["value"] != c["value"]) & d["value"].contains(c["value"])))

    findings = bound(F.filter(F.transform(candidates(text_or_empty()), scored), lambda c: c["score"] >= limit), widest)
    return docs.select(*[c for c in docs.columns if c != "findings"], findings.alias("findings"))


#: A run of spaces or a word.
_RUN = r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))


def _first_word(text: Column) -> Column:
    """The place of the first word among the runs: 1 behind spaces, else 0."""
    return text.rlike(r"^[\x20\x09-\x0D]").cast("int")


def redacted(text: Column, findings: Column) -> Column:
    """The text with a mark in place of each secret, in the word that it was found in and nowhere else; long ones first, as one can be part of another."""
    longest = F.array_sort(findings, lambda a, b: F.char_length(b["value"]) - F.char_length(a["value"]))

    def word(run: Column, i: Column) -> Column:
        mine = F.filter(longest, lambda c: 2 * c["at"] + _first_word(text) == i)
        return F.aggregate(mine, run, lambda t, c: F.replace(t, c["value"], F.lit(MARK)))

    return F.array_join(F.transform(_runs(text), word), "")


def spans(found: DataFrame) -> DataFrame:
    """A row for each finding of ``scanned`` with its first place in the text: start and length, in code points."""
    rows = found.where(F.size("findings") > 0).withColumn("_runs", _runs(F.col("text"))).withColumn("_c", F.explode("findings"))
    run = 2 * F.col("_c.at") + _first_word(F.col("text"))
    before = F.char_length(F.array_join(F.slice("_runs", F.lit(1), run), ""))
    start = before + F.instr(F.get("_runs", run), F.col("_c.value")) - 1
    return rows.select(*[c for c in found.columns if c not in ("findings", "start", "length")], F.col("_c").alias("finding"), start.cast("long").alias("start"), F.char_length("_c.value").cast("long").alias("length"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = spans(scanned(docs, trained(spark)))
    return found.select("doc_id", F.col("finding.at").alias("word_at"), "start", "length", F.col("finding.kind").alias("kind"), F.col("finding.value").alias("value"), F.round("finding.score", 6).alias("score"))
