"""Labelled findings for the secret scanner's forest, made by a seeded rule.

No table has labelled findings. These are keys and passwords as providers form
them, against commits, checksums, ids, versions, paths, addresses, dates, card
and phone numbers, placeholders and words with digits. They are training data of
a fixed, small size that does not depend on the documents: a local table, no
part of any scan.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FINDINGS = 6000
_SYLLABLES = ("ka", "lo", "mi", "ren", "tus", "ver", "ola", "nt", "ing", "pre", "con", "sta", "dor", "fel", "gu", "hi", "bo", "dy", "se", "qui")
_FILLERS = ("the", "of", "and", "we", "see", "der", "la", "que", "thing", "ontion", "set", "with", "in")
_SECRET_KEYS = ("password", "passwd", "db_password", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "SECRET_KEY")
_OTHER_KEYS = ("id", "version", "file", "name", "order_id", "sha256", "etag", "url", "path", "ref")
_EMPTY = (
    "true", "false", "null", "None", "undefined", "required", "optional", "changeme", "xxxxxxxx", "********", "****", "......", "${PASSWORD}", "$TOKEN", "<password>", "{{secret}}",
    "process.env.TOKEN", "os.environ", "getenv", "string", "hidden", "redacted", "[SECRET]", "-----",
)
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class _Maker:
    def __init__(self, seed: int, dictionary: tuple[str, ...]):
        self.r, self.dictionary = random.Random(seed), dictionary

    def of(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choices(chars, k=self.r.randint(low, high or low)))

    def mixed(self, low: int, high: int | None = None) -> str:
        return self.of(_MIXED, low, high)

    def hex(self, low: int = 16, high: int = 64) -> str:
        return self.of("0123456789abcdef", self.r.choice((16, 20, 24, 32, 40, 64, self.r.randint(low, high))))

    def word(self) -> str:
        return self.r.choice(self.dictionary)

    def made_up(self, low: int = 2, high: int = 4) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(low, high)))

    def plain(self) -> str:
        return f"{self.r.choice(_FILLERS)} {self.r.choice((*_FILLERS, self.made_up()))}"

    def spoken(self) -> str:
        return f"{self.r.choice(_SECRET_KEYS)} {self.r.choice('=:=')}"

    def key(self) -> str:
        return self.r.choice(_SECRET_KEYS)

    def uuid(self) -> str:
        return "-".join(self.of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))

    def mark(self) -> str:
        return self.r.choice("!#$%@*?^&")


def _kinds(m: _Maker) -> list[Callable[[], tuple[int, str, str, str]]]:
    """Each gives (label, value, key, before)."""
    r, n = m.r, m.r.randint
    other = lambda: r.choice(_OTHER_KEYS)
    told = lambda value: (value, m.key(), m.plain()) if r.random() < 0.5 else (value, "", m.spoken())
    return [
        lambda: (1, r.choice(("AKIA", "ASIA")) + m.mixed(16).upper(), r.choice(("", "", "AWS_ACCESS_KEY_ID")), m.plain()),
        lambda: (1, r.choice(("ghp_", "gho_", "glpat-", "npm_", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "sk-")) + m.mixed(24, 40), "", m.plain()),
        lambda: (1, *told(m.hex())),
        lambda: (1, m.hex(), m.key(), m.plain()),
        lambda: (1, m.mixed(14, 64), m.key(), m.plain()),
        lambda: (1, m.mixed(14, 64), "", m.spoken()),
        lambda: (1, f"eyJ{m.mixed(30, 60)}.{m.mixed(40, 64)}", "", r.choice(("Authorization: Bearer", m.plain()))),
        lambda: (1, base64.b64encode(r.randbytes(n(24, 40))).decode(), *told("")[1:]),
        lambda: (0, m.hex(), "", f"{r.choice(_FILLERS)} {r.choice(('commit', 'sha256', 'md5', 'checksum', 'hash', 'rev', 'digest'))}"),
        lambda: (0, m.hex(), r.choice(("commit", "sha256", "etag_hash", "checksum")), m.plain()),
        lambda: (0, m.uuid(), "", m.plain()),
        lambda: (0, m.uuid(), r.choice(("id", "uuid", "request_id")), m.plain()),
        lambda: (0, f"{m.word()}{m.word()}{n(1, 2030)}placeholder", m.key(), m.plain()),
        lambda: (0, f"your_{m.word()}{r.choice('_-')}example{n(1, 99)}", "", m.spoken()),
        lambda: (0, f"{r.choice(('v', 'release-', 'build-'))}{n(1, 20)}.{n(0, 40)}.{n(0, 99)}-{m.word()}", other(), m.plain()),
        lambda: (0, f"{m.word()}/{m.word()}/{n(1, 2030)}/{m.word()}-{m.word()}.html", "", m.plain()),
        lambda: (0, f"//www.{m.word()}{m.made_up()}.com/{m.word()}{n(1, 9999)}", "https", m.plain()),
        lambda: (0, f"{n(1995, 2030)}-{n(1, 12):02}-{n(1, 28):02}T{n(0, 23):02}.{n(0, 59):02}.{n(0, 59):02}Z", "", m.plain()),
        lambda: (0, m.of("0123456789", 12, 19), "", m.plain()),
        lambda: (0, m.of("0123456789", 12, 16), other(), m.plain()),
        lambda: (0, f"{m.word()}{m.word()}{m.word()}{n(1, 999)}", "", m.plain()),
        lambda: (0, f"{m.word()}{n(1, 99)}{m.word()}_{m.word()}", "", m.plain()),
        lambda: (0, f"{m.word()}.{m.word()}{n(1, 99)}.{m.word()}.com", "", f"{r.choice(_FILLERS)} mail:"),
        lambda: (0, f"555-{m.of('0123456789', 3)}-{m.of('0123456789', 4)}", "", f"{r.choice(_FILLERS)} {r.choice(('phone', 'tel', 'call'))}"),
        lambda: (1, m.mixed(6, 13), m.key(), m.plain()),
        lambda: (1, f"{m.mixed(5, 12)}{n(0, 9)}", "", m.spoken()),
        lambda: (1, m.of(_MIXED[:52], 14, 34), m.key(), m.plain()),
        lambda: (1, m.of(_MIXED[26:52], 14, 34), m.key(), m.plain()),
        lambda: (1, m.of(_MIXED[26:52], 14, 34), "", m.spoken()),
        lambda: (1, f"{r.choice((m.word(), m.made_up())).capitalize()}{m.mark()}{n(1, 9999)}{m.mark()}{m.mixed(1, 6)}", m.key(), m.plain()),
        lambda: (1, f"{m.mixed(2, 6)}{m.mark()}{m.mixed(4)}{m.mark()}", "", m.spoken()),
        lambda: (1, f"{m.made_up()}{n(1, 9999)}{r.choice(('', '', '!'))}", m.key(), m.plain()),
        lambda: (0, m.word(), m.key(), m.plain()),
        lambda: (0, m.made_up(), "", m.spoken()),
        lambda: (0, m.made_up(), m.key(), m.plain()),
        lambda: (0, m.made_up(3, 6), "", m.spoken()),
        lambda: (0, r.choice(_EMPTY), m.key(), m.plain()),
        lambda: (0, r.choice(_EMPTY), "", m.spoken()),
        lambda: (0, m.of("0123456789", 4, 10), r.choice(("key", "access", "api", "token_count", "max_tokens", "keyboard")), m.plain()),
        lambda: (0, f"/{m.word()}/{m.made_up()}.{r.choice(('pem', 'txt', 'json', 'key'))}", r.choice(("token_file", "key_path", "secret_file")), m.plain()),
        lambda: (0, f"{m.made_up(3, 6)}.{n(1, 99)}", "", m.plain()),
        lambda: (0, f"{r.choice(('mail', 'db', 'www', 'api'))}{n(1, 9)}.{m.made_up()}{r.choice(('.com', '.org', '.net/prod', '.com/cb'))}", r.choice(("", "", "https", "host")), m.plain()),
        lambda: (0, f"{m.word()}{r.choice('-_')}{m.word()}{r.choice('-_')}{m.made_up()}{n(1, 99)}", r.choice(("", other())), m.plain()),
    ]


def labelled_findings(spark: SparkSession, dictionary: tuple[str, ...], rows: int = FINDINGS, seed: int = 9) -> DataFrame:
    """(label, value, key, before, after, path); one partition, so that training sees one order."""
    m = _Maker(seed, dictionary)
    kinds = _kinds(m)
    out = []
    for i in range(rows):
        label, value, key, before = kinds[i % len(kinds)]()
        out.append({"label": label, "value": value, "key": key, "before": before, "after": m.r.choice(_FILLERS), "path": m.r.choice(("src1", "src/app.py", "config", "docs/readme", "tests/unit", ""))})
    kind = pa.schema([("label", pa.int32()), *[(c, pa.string()) for c in ("value", "key", "before", "after", "path")]])
    return spark.createDataFrame(pa.Table.from_pylist([x for x in out if len(x["value"]) >= 4], kind)).coalesce(1)
