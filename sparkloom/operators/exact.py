"""Exact encoders and decoders of tool output: shorter text from which the original comes back byte for byte.

Every rule is total and checked: a rule's output is used only if it is shorter, costs no more
estimated tokens and decodes to its input.  Blocks stand between ``[sl:NAME ...]`` and ``[/sl]``; text
that already looks like that is escaped first.  The work depends on the order of lines within one
text, so it runs row by row in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "[/sl]"
_OPEN = re.compile(r"^\[sl:([a-z]+)(?: (.*))?\]$")
_MARKER = re.compile(r"^(\\*)(\[/?sl[:\]= ])", re.M)
_ESCAPED = re.compile(r"^\\(\\*\[/?sl[:\]= ])", re.M)
_PIECE = re.compile(r" ?[A-Za-z]+|\d{1,3}|\n+|[^\sA-Za-z\d]{1,2}|\s+|[^\x00-\x7f]")
#: Least rows of a numbered block or a table, least lines of other blocks.
ROWS, LEAST = 12, 3


def estimate(text: str) -> int:
    """Rough token count: words by 7 letters, digits by 3, punctuation by 2."""
    return sum(1 + (len(g.strip()) - 1) // 7 if g[-1].isalpha() else 1 for g in _PIECE.findall(text))


def escape(text: str) -> str:
    return _MARKER.sub(r"\\\1\2", text) if "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _runs(lines: list[str], parse: Callable) -> Iterator[tuple[int, int, list]]:
    """Maximal runs of lines that parse to values with one key: (first, last, values)."""
    i = 0
    while i < len(lines):
        first = parse(lines[i])
        if first is None:
            i += 1
            continue
        j, values = i, []
        while j < len(lines) and (value := parse(lines[j])) is not None and value[0] == first[0]:
            values.append(value)
            j += 1
        yield i, j, values
        i = j


def _replace(lines: list[str], parse: Callable, build: Callable, least: int) -> list[str]:
    """Runs of `least` lines as blocks where a block pays."""
    out, done = [], 0
    for i, j, values in _runs(lines, parse):
        if j - i < least:
            continue
        block = build(values)
        if block and sum(map(len, block)) + len(block) + 8 < sum(map(len, lines[i:j])) + j - i:
            out += lines[done:i] + block
            done = j
    return out + lines[done:]


# Search hits: path and line number in front of every line.
_HIT = re.compile(r"^([^\s:@][^:\n]*?)([:-])(\d+)\2(.*)$")


def enc_hits(lines):
    def parse(x):
        m = _HIT.match(x)
        return ("", *m.groups()) if m else None

    def build(values):
        if not any(v[2] == ":" for v in values):
            return None
        block, path = ["[sl:hits]"], None
        for _, p, sep, n, rest in values:
            if p != path:
                block.append("@" + p)
                path = p
            block.append(n + sep + rest)
        return [*block, END]

    return _replace(lines, parse, build, LEAST)


def dec_hits(args, body):
    path, out = "", []
    for x in body:
        if x.startswith("@"):
            path = x[1:]
        else:
            n = re.match(r"\d+", x)[0]
            out.append(f"{path}{x[len(n)]}{n}{x[len(n):]}")
    return out


# Bare paths, grouped by folder.
_PATH = re.compile(r"^((?:[^\s@/][^\s/]*)?/(?:[^\s/]+/)*)([^\s/]+)$")


def enc_paths(lines):
    def parse(x):
        m = _PATH.match(x)
        return ("", *m.groups()) if m else None

    def build(values):
        block, folder = ["[sl:paths]"], None
        for _, d, name in values:
            if d != folder:
                block.append("@" + d)
                folder = d
            block.append(" " + name)
        return [*block, END]

    return _replace(lines, parse, build, 4)


def dec_paths(args, body):
    folder, out = "", []
    for x in body:
        if x.startswith("@"):
            folder = x[1:]
        else:
            out.append(folder + x[1:])
    return out


# Line numbers in a padded gutter.
_GUTTER = re.compile(r"^( *)(\d+)(\t|→|\| ?|: ?)(.*)$")


def enc_numbered(lines):
    def parse(x):
        m = _GUTTER.match(x)
        if not m or (m[1] and m[2][0] == "0"):
            return None
        zero = not m[1] and len(m[2]) > 1 and m[2][0] == "0"
        return (len(m[1]) + len(m[2]), zero), (m[2].lstrip("0") or "0") if zero else m[2], m[3] + m[4]

    def build(values):
        (width, zero), _, _ = values[0]
        return [f"[sl:numbered {width}{'z' * zero}]", *[n + rest for _, n, rest in values], END]

    # A number that fills its gutter has no padding, and either kind may follow it.
    def joined(x):
        v = parse(x)
        return v if v is None or not (v[1] and len(v[1]) == v[0][0] and not v[0][1]) else ((v[0][0], None), v[1], v[2])

    keys = [parse(x) for x in lines]
    for i in range(1, len(lines)):
        if keys[i] and keys[i - 1] and keys[i][0] != keys[i - 1][0] and joined(lines[i])[0] == (keys[i - 1][0][0], None):
            keys[i] = (keys[i - 1][0], keys[i][1], keys[i][2])
    by_line = iter(range(len(lines)))
    tagged = list(zip(by_line, keys, strict=True))
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and tagged[j][1] and tagged[i][1] and tagged[j][1][0] == tagged[i][1][0]:
            j += 1
        block = build([tagged[k][1] for k in range(i, j)]) if j - i >= ROWS else None
        if block and sum(map(len, block)) + len(block) + 40 < sum(map(len, lines[i:j])) + j - i:
            out += block
        else:
            out += lines[i : max(j, i + 1)]
        i = max(j, i + 1)
    return out


def dec_numbered(args, body):
    zero, width = args.endswith("z"), int(args.rstrip("z"))
    out = []
    for x in body:
        n = re.match(r"\d+", x)[0]
        out.append((n.zfill(width) if zero else n.rjust(width)) + x[len(n) :])
    return out


# Aligned tables: single blanks between columns.
def enc_table(lines):
    def columns(head):
        starts = [0, *(m.end() for m in re.finditer(r"(?<=\S) {2,}(?=\S)", head))]
        return starts if head[:1].strip() and len(starts) >= 3 else None

    def split(x, starts):
        fields = [x[a:b].rstrip(" ") for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if len(x) < starts[-1] or any(not f or " " in f for f in fields):
            return None
        fields.append(x[starts[-1] :])
        return fields if fixed(fields, starts) == x else None

    def fixed(fields, starts):
        return "".join(f.ljust(b - a) for f, a, b in zip(fields[:-1], starts[:-1], starts[1:], strict=True)) + fields[-1]

    out, i = [], 0
    while i < len(lines):
        starts, rows, j = columns(lines[i]), [], i
        while starts and j < len(lines) and (fields := split(lines[j], starts)):
            rows.append(" ".join(fields))
            j += 1
        block = [f"[sl:table {' '.join(map(str, starts))}]", *rows, END] if len(rows) >= ROWS else None
        if block and estimate("\n".join(block)) < estimate("\n".join(lines[i:j])):
            out += block
            i = j
        else:
            out.append(lines[i])
            i += 1
    return out


def dec_table(args, body):
    starts = [int(x) for x in args.split()]
    out = []
    for x in body:
        fields = x.split(" ", len(starts) - 1)
        out.append("".join(f.ljust(b - a) for f, a, b in zip(fields[:-1], starts[:-1], starts[1:], strict=True)) + fields[-1])
    return out


# A prefix up to a delimiter that lines share.
_PREFIX = re.compile(r"^(\S{4,}?[\]:|>] ?)(.*)$")


def enc_prefix(lines):
    def parse(x):
        m = _PREFIX.match(x)
        return m.groups() if m else None

    return _replace(lines, parse, lambda v: [f"[sl:prefix {json.dumps(v[0][0])}]", *["|" + x[1] for x in v], END], LEAST)


def dec_prefix(args, body):
    return [json.loads(args) + x[1:] for x in body]


# Page snapshots: list items of a yaml block with references.
_ITEM, _CURSOR, _ARROW = re.compile(r"^( *)- (.*)$"), " [cursor=pointer]", " ↗"


def enc_snapshot(lines):
    out, i = [], 0
    while i < len(lines):
        stop = next((j for j in range(i + 1, len(lines)) if lines[j] == "```"), None) if lines[i] == "```yaml" else None
        body = lines[i + 1 : stop] if stop else []
        items = [_ITEM.match(x) for x in body]
        if items and all(items) and any("[ref=" in x for x in body):
            arrow = not any("↗" in x for x in body)
            new = [m[1] + m[2] for m in items]
            out += ["```yaml", f"[sl:snapshot{' a' if arrow else ''}]", *["|" + (x.replace(_CURSOR, _ARROW) if arrow else x) for x in new], END, "```"]
            i = stop + 1
        else:
            out.append(lines[i])
            i += 1
    return out


def dec_snapshot(args, body):
    out = []
    for x in body:
        x = x[1:].replace(_ARROW, _CURSOR) if args == "a" else x[1:]
        rest = x.lstrip(" ")
        out.append(" " * (len(x) - len(rest)) + "- " + rest)
    return out


# Diff headers that repeat the line `diff --git`.
_DIFF = re.compile(r"^diff --git a/(\S+) b/(\S+)$")


def enc_diff(lines):
    names, out = None, []
    for k, x in enumerate(lines):
        m = _DIFF.match(x)
        names = m.groups() if m else names
        follows = lines[k + 1] if k + 1 < len(lines) else ""
        if names and x == f"--- a/{names[0]}" and follows == f"+++ b/{names[1]}" and k + 2 < len(lines) and lines[k + 2].startswith("@@ "):
            out.append(None)
        elif out and out[-1] is None and names and x == f"+++ b/{names[1]}":
            out.append(None)
            names = None
        else:
            out.append(x)
    return ["[sl:diff]", *[x for x in out if x is not None], END] if None in out else lines


def dec_diff(args, body):
    names, seen, out = None, False, []
    for x in body:
        m = _DIFF.match(x)
        if m:
            names, seen = m.groups(), False
        elif x.startswith("--- "):
            seen = True
        elif x.startswith("@@ ") and names and not seen:
            out += [f"--- a/{names[0]}", f"+++ b/{names[1]}"]
            seen = True
        out.append(x)
    return out


# Runs of lines that stood earlier in the same text.
_REF = re.compile(r"^\[sl:= (\d+)-(\d+)\]$")


def enc_repeats(lines):
    where: dict[str, list[int]] = {}
    out: list[str] = []
    i = 0
    while i < len(lines):
        best = (0, 0)
        for at in where.get(lines[i], ())[-16:]:
            n = 0
            while i + n < len(lines) and at + n < len(out) and not _REF.match(out[at + n]) and out[at + n] == lines[i + n]:
                n += 1
            best = max(best, (n, at))
        n, at = best
        mark = f"[sl:= {at + 1}-{at + n}]"
        if n and sum(map(len, lines[i : i + n])) + n >= 40 and estimate("\n".join(lines[i : i + n])) >= estimate(mark) + 4:
            out.append(mark)
            i += n
        else:
            where.setdefault(lines[i], []).append(len(out))
            out.append(lines[i])
            i += 1
    return out


def dec_repeats(lines):
    out = []
    for x in lines:
        m = _REF.match(x)
        out += lines[int(m[1]) - 1 : int(m[2])] if m else [x]
    return out


# JSON: a document must come back byte for byte from one of four layouts.
_LAYOUTS = [{"ensure_ascii": a, "separators": s} for a in (False, True) for s in ((",", ":"), (", ", ": "))]


def _load(text: str):
    """(value, layout number) of a JSON text in a known layout, else None."""
    if text[:1] not in "[{" or text != text.strip():
        return None
    try:
        value = json.loads(text)
        for k, how in enumerate(_LAYOUTS):
            if json.dumps(value, **how) == text:
                return value, k
    except (ValueError, RecursionError):
        pass
    return None


def _dump(value, k: int) -> str:
    return json.dumps(value, **_LAYOUTS[k])


def _columns(rows: list[dict]) -> list[str] | None:
    """An order of all keys that every record follows."""
    order: list[str] = []
    for r in rows:
        order += [k for k in r if k not in order]
    place = {k: i for i, k in enumerate(order)}
    return order if all([place[k] for k in r] == sorted(place[k] for k in r) for r in rows) else None


def enc_rows(text: str) -> str:
    """Arrays of three records or more as tab-separated blocks."""
    found = _load(text)
    if not found:
        return text
    value, k = found
    blocks: list[str] = []

    def walk(x):
        if isinstance(x, list):
            if len(x) >= 3 and all(isinstance(r, dict) and r for r in x) and (keys := _columns(x)):
                plain = [c for c in keys if all(isinstance(r.get(c), str) and not re.search(r"[\t\n\r\\]|^\[", r[c]) for r in x)]
                rows = ["\t".join(r[c] if c in plain else _dump(r[c], k) if c in r else "" for c in keys) for r in x]
                head = json.dumps([[c, int(c in plain)] for c in keys], separators=(",", ":"))
                if not any("\n" in r or r.startswith("[") for r in rows) and len("\n".join(rows)) + len(head) + 20 < len(_dump(x, k)):
                    blocks.append("\n".join([f"[sl:rows {k} {head}]", *rows, END]))
                    return f"[sl:rows {len(blocks)}]"
            return [walk(y) for y in x]
        return {c: walk(y) for c, y in x.items()} if isinstance(x, dict) else x

    outer = _dump(walk(value), k)
    return "\n".join([outer, *blocks]) if blocks else text


def dec_rows(text: str) -> str:
    lines = text.split("\n")
    if len(lines) < 3 or not lines[1].startswith("[sl:rows "):
        return text
    tables, i, k = [], 1, 0
    while i < len(lines):
        _, layout, head = lines[i][:-1].split(" ", 2)
        k, keys, rows = int(layout), json.loads(head), []
        i += 1
        while lines[i] != END:
            rows.append({c: x if plain else json.loads(x) for (c, plain), x in zip(keys, lines[i].split("\t"), strict=True) if plain or x})
            i += 1
        tables.append(rows)
        i += 1

    def walk(x):
        if isinstance(x, str) and (m := re.fullmatch(r"\[sl:rows (\d+)\]", x)):
            return tables[int(m[1]) - 1]
        return [walk(y) for y in x] if isinstance(x, list) else {c: walk(y) for c, y in x.items()} if isinstance(x, dict) else x

    return _dump(walk(json.loads(lines[0])), k)


def enc_defs(text: str) -> str:
    """Objects that repeat, defined once (60 definitions at most, 24 characters each at least)."""
    found = _load(text)
    if not found or len(text) > 400_000 or "@@" in text:
        return text
    value, k = found
    seen: Counter = Counter()

    def walk(x):
        if isinstance(x, dict):
            seen[_dump(x, k)] += 1
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            walk(y)

    walk(value)
    defs = [s for s, n in sorted(seen.items(), key=lambda x: -len(x[0]) * x[1]) if n >= 2 and len(s) >= 24][:60]
    out, used = text, []
    for s in defs:
        if out.count(s) >= 2:
            out = out.replace(s, f"@@{len(used)}@@")
            used.append(s)
    return "\n".join([out, "[sl:defs]", *used, END]) if used else text


def dec_defs(text: str) -> str:
    body, mark, tail = text.partition("\n[sl:defs]\n")
    if not mark:
        return text
    defs = tail.split("\n")[:-1]
    for n in range(len(defs) - 1, -1, -1):
        body = body.replace(f"@@{n}@@", defs[n])
    return body


_UNICODE = re.compile(r"(?<!\\)((?:\\\\)*)((?:\\u[0-9a-fA-F]{4})+)")


def enc_ascii(text: str) -> str:
    """Escaped letters of JSON strings as themselves; the case of the hex digits is kept."""
    if "\\u" not in text or not text.isascii() or not _load(text):
        return text
    upper = bool(re.search(r"\\u[0-9a-f]*[A-F]", text))

    def plain(m):
        s = json.loads(f'"{m[2]}"')
        return m[1] + (s if all(ord(c) > 0x9F and not 0xD800 <= ord(c) < 0xE000 and c not in "  " for c in s) else m[2])

    return f"[sl:ascii {'U' if upper else 'l'}]\n" + _UNICODE.sub(plain, text)


def dec_ascii(text: str) -> str:
    m = re.match(r"\[sl:ascii (U|l)\]\n", text)
    if not m:
        return text
    case = str.upper if m[1] == "U" else str.lower

    def escaped(x):
        return "".join("\\u" + case(f"{u:04x}") for u in memoryview(x[0].encode("utf-16-le")).cast("H"))

    return re.sub(r"[^\x00-\x7f]", escaped, text[m.end() :])


def enc_files(text: str) -> str:
    """{"files": [...]} as one path a line."""
    found = _load(text)
    if not found or not isinstance(found[0], dict) or list(found[0]) != ["files"]:
        return text
    files, k = found[0]["files"], found[1]
    if not isinstance(files, list) or len(files) < LEAST or not all(isinstance(f, str) and f and not re.search(r"[\n\r]|^\[", f) for f in files):
        return text
    return "\n".join([f"[sl:files {k}]", *files])


def dec_files(text: str) -> str:
    m = re.match(r"\[sl:files (\d)\]\n", text)
    return _dump({"files": text[m.end() :].split("\n")}, int(m[1])) if m else text


BLOCKS = {"hits": dec_hits, "paths": dec_paths, "numbered": dec_numbered, "table": dec_table, "prefix": dec_prefix, "snapshot": dec_snapshot, "diff": dec_diff}
TEXT_RULES = {"rows": (enc_rows, dec_rows), "defs": (enc_defs, dec_defs), "ascii": (enc_ascii, dec_ascii), "files": (enc_files, dec_files)}
LINE_RULES = {"diff": enc_diff, "snapshot": enc_snapshot, "hits": enc_hits, "paths": enc_paths, "numbered": enc_numbered, "table": enc_table, "prefix": enc_prefix, "repeats": enc_repeats}
DEFAULT = ("ascii", "files", "rows", "defs", "diff", "snapshot", "hits", "paths", "numbered", "table", "prefix")


#: Characters that decoding may make of one text; more is a forged block.
LIMIT = 64 << 20


def _unblock(lines: list[str], limit: int = LIMIT) -> list[str]:
    """All blocks decoded, inner ones first; ValueError once they hold more than `limit` characters."""
    stack: list[tuple[str, str, list[str]]] = [("", "", [])]
    made = 0
    for x in lines:
        m = _OPEN.match(x)
        if m and m[1] in BLOCKS:
            stack.append((m[1], m[2] or "", []))
        elif x == END and len(stack) > 1:
            name, args, body = stack.pop()
            lines_ = BLOCKS[name](args, body)
            made += sum(map(len, lines_)) + len(lines_)
            if made > limit:
                raise ValueError(f"blocks of over {limit} characters")
            stack[-1][2].extend(lines_)
        else:
            stack[-1][2].append(x)
    return stack[0][2]


def apply_rule(name: str, text: str) -> str:
    """One rule's output if it is shorter, costs no more tokens and decodes; else the text."""
    try:
        if name in TEXT_RULES:
            encode, back = TEXT_RULES[name]
            new = encode(text)
            exact = new == text or back(new) == text
        elif name == "repeats":
            new = "\n".join(enc_repeats(text.split("\n")))
            exact = "\n".join(dec_repeats(new.split("\n"))) == text
        else:
            new = "\n".join(LINE_RULES[name](text.split("\n")))
            exact = "\n".join(_unblock(new.split("\n"))) == text
    except (ValueError, IndexError, KeyError, TypeError, RecursionError):
        return text
    return new if exact and len(new) < len(text) and estimate(new) <= estimate(text) else text


def encode(text: str, rules=DEFAULT) -> tuple[str, list[str]]:
    """(encoded text, rules that fired).  One text rule at most, then line rules on plain text; texts
    with CRLF are encoded with plain line ends where all are alike."""
    crlf = "\r\n" in text and text.count("\r\n") == text.count("\n") == text.count("\r")
    out = escape(text.replace("\r\n", "\n") if crlf else text)
    fired = []
    for name in rules:
        if fired and (fired[0] in TEXT_RULES or name in TEXT_RULES):
            break
        new = apply_rule(name, out)
        if new != out:
            out, fired = new, [*fired, name]
    if not fired:
        return text, []
    if crlf:
        out, fired = "[sl:crlf]\n" + out, ["crlf", *fired]
    return (out, fired) if decode(out, fired) == text and len(out) < len(text) else (text, [])


def decode(text: str, fired: list[str]) -> str:
    """The original of an encoded text."""
    if not fired:
        return text
    crlf = fired[0] == "crlf"
    out = text.removeprefix("[sl:crlf]\n") if crlf else text
    for name in reversed(fired):
        if name in TEXT_RULES:
            out = TEXT_RULES[name][1](out)
        elif name == "repeats":
            out = "\n".join(dec_repeats(out.split("\n")))
    if any(name in LINE_RULES and name != "repeats" for name in fired):
        out = "\n".join(_unblock(out.split("\n")))
    out = unescape(out)
    return out.replace("\n", "\r\n") if crlf else out


def encoded(c: Column, rules=DEFAULT) -> Column:
    """struct(text, rules): null texts give a null text and no rules."""

    @F.pandas_udf("text string, rules array<string>")
    def go(texts: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else encode(t, rules) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "rules": [d[1] for d in done]})

    return go.asNondeterministic()(c)  # encoded once, however often its fields are used


def decoded(c: Column, rules: Column) -> Column:
    @F.pandas_udf("string")
    def go(texts: pd.Series, fired: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else decode(t, list(r)) for t, r in zip(texts, fired, strict=True)], dtype=object)

    return go(c, rules)


def round_trip(docs: DataFrame, text_col: str, rules=DEFAULT) -> DataFrame:
    """docs with encoded text, the rules that fired, saved characters, and exact (decoding gives the text)."""
    done = docs.withColumn("_e", encoded(F.col(text_col), rules))
    out = done.withColumn("encoded", F.col("_e.text")).withColumn("rules", F.col("_e.rules")).drop("_e")
    return out.withColumn("saved", (F.length(text_col) - F.length("encoded")).cast("long")).withColumn("exact", decoded(F.col("encoded"), F.col("rules")).eqNullSafe(F.col(text_col)))
