"""Schemas of the files that the readers take; nothing is inferred."""

from __future__ import annotations

RAW = (
    "id string, source string, source_url string, exam string, section string, mondai int, type string, passage string, passage_id string, "
    "question string, options array<string>, answer int, explanation string, audio string, image string, transcript string, furigana boolean, level string, level_hint string"
)
ANNOTATION = "map<string, struct<opts: array<string>, trans: string, note: string>>"
FIXES = "id string, field string, old string, new string"
CARD = "struct<box: int, due: bigint, reps: int, lapses: int, added: bigint, last: bigint, reason: string, flagged: boolean, u: bigint>"
STATE = (
    "version int, app string, exportedAt string, exportedFrom string, "
    "stats map<string, struct<n: int, c: int, last: bigint, w: int, u: bigint>>, "
    f"srs map<string, {CARD}>, gcards map<string, {CARD}>, "
    "daily map<string, struct<answered: int, correct: int, secs: int, `by`: map<string, struct<a: int, c: int, s: int>>>>, notes map<string, string>, "
    "study map<string, struct<done: int, c: int, n: int, best: double, at: bigint, wrong: array<string>, tries: int, u: bigint>>, "
    "meta struct<epoch: struct<id: string, at: bigint>, del: map<string, bigint>, noteAt: map<string, bigint>, settingsAt: bigint>"
)
LESSON = (
    "id string, track string, label string, title string, "
    "quiz array<struct<id: string, pass: string, q: string, options: array<string>, answer: int>>, "
    "practice array<struct<id: string, pass: string, q: string, options: array<string>, answer: int>>, "
    "test array<struct<id: string, pass: string, q: string, options: array<string>, answer: int>>, passages map<string, string>"
)
