"""Text functions: tokens of identifiers and prose, abbreviations, chunks of source files, path proximity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from semaloom.config import CHUNK_CAP, MAX_TOKEN_LENGTH, MAX_TOKENS, MIN_TOKEN_LENGTH, PROXIMITY_BOOST

# Characters that part tokens, places where a capital parts them, abbreviations and what they stand for.
DELIMITERS = " \n\t\r./_-(),:{}[]=;$@%#><&|!\"'`+*?^~\\"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
ABBREVIATIONS = {
    "err": "error",
    "exc": "exception",
    "ex": "exception",
    "ctx": "context",
    "cfg": "config",
    "conf": "configuration",
    "env": "environment",
    "opt": "option",
    "opts": "options",
    "req": "request",
    "res": "response",
    "resp": "response",
    "rsp": "response",
    "hdr": "header",
    "hdrs": "headers",
    "str": "string",
    "fmt": "format",
    "msg": "message",
    "txt": "text",
    "lbl": "label",
    "desc": "description",
    "buf": "buffer",
    "arr": "array",
    "vec": "vector",
    "lst": "list",
    "dict": "dictionary",
    "tbl": "table",
    "stk": "stack",
    "que": "queue",
    "fn": "function",
    "func": "function",
    "cb": "callback",
    "proc": "procedure",
    "ctor": "constructor",
    "dtor": "destructor",
    "db": "database",
    "col": "column",
    "stmt": "statement",
    "txn": "transaction",
    "trx": "transaction",
    "repo": "repository",
    "auth": "authentication",
    "authz": "authorization",
    "perm": "permission",
    "cred": "credential",
    "tok": "token",
    "pwd": "password",
    "val": "value",
    "num": "number",
    "int": "integer",
    "bool": "boolean",
    "flt": "float",
    "dbl": "double",
    "idx": "index",
    "iter": "iterator",
    "elem": "element",
    "cnt": "count",
    "len": "length",
    "sz": "size",
    "pos": "position",
    "off": "offset",
    "cap": "capacity",
    "init": "initialize",
    "deinit": "deinitialize",
    "alloc": "allocate",
    "dealloc": "deallocate",
    "del": "delete",
    "rm": "remove",
    "impl": "implementation",
    "iface": "interface",
    "abs": "abstract",
    "decl": "declaration",
    "param": "parameter",
    "arg": "argument",
    "attr": "attribute",
    "prop": "property",
    "ret": "return",
    "src": "source",
    "dst": "destination",
    "tgt": "target",
    "orig": "original",
    "prev": "previous",
    "cur": "current",
    "tmp": "temporary",
    "temp": "temporary",
    "conn": "connection",
    "sess": "session",
    "sock": "socket",
    "addr": "address",
    "url": "uniform",
    "srv": "server",
    "cli": "client",
    "svc": "service",
    "ep": "endpoint",
    "mgr": "manager",
    "ctrl": "controller",
    "hdlr": "handler",
    "sched": "scheduler",
    "disp": "dispatcher",
    "reg": "registry",
    "chan": "channel",
    "sem": "semaphore",
    "mtx": "mutex",
    "wg": "waitgroup",
    "sig": "signal",
    "evt": "event",
    "pub": "publisher",
    "spec": "specification",
    "mock": "mock",
    "stub": "stub",
    "assert": "assertion",
    "log": "logging",
    "lvl": "level",
    "dbg": "debug",
    "wrn": "warning",
    "inf": "info",
    "ts": "timestamp",
    "dur": "duration",
    "ttl": "timetolive",
    "ver": "version",
    "ns": "namespace",
    "pkg": "package",
    "mod": "module",
    "lib": "library",
    "dep": "dependency",
    "ref": "reference",
    "ptr": "pointer",
    "obj": "object",
    "doc": "document",
    "cmd": "command",
    "ops": "operations",
    "util": "utility",
    "hlp": "helper",
    "ext": "extension",
}

#: Characters that tokens lose, of scripts that are common: a table look-up is several times as fast as the pattern that takes the rest.
DROPPED = "".join(chr(c) for low, high in ((0x01, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x24F), (0x370, 0x4FF), (0x2010, 0x2027)) for c in range(low, high + 1))


def tokenize(text: Column, abbrev: bool = True, most: int = MAX_TOKENS) -> Column:
    """Tokens of a text: parted at delimiters and camel breaks, lower case, 2 to 255 ASCII letters and digits.

    Other characters are dropped without parting, but a capital after one is no camel break. At
    most ``most`` tokens are kept; the expansions of abbreviations follow at the end, as far as
    there is room. The text ends at a NUL. Null has no tokens.
    """
    whole = F.regexp_replace(F.substring_index(F.coalesce(text, F.lit("")), "\u0000", 1), CAMEL, " ")
    plain = F.lower(F.regexp_replace(F.translate(whole, DELIMITERS + DROPPED, " " * len(DELIMITERS)), "[^A-Za-z0-9 ]+", ""))
    fits = lambda t: F.length(t).between(MIN_TOKEN_LENGTH, MAX_TOKEN_LENGTH)
    tokens = F.slice(F.filter(F.split(plain, " "), fits), 1, most)
    return expand(tokens, most) if abbrev else tokens


#: What ``tokens_of`` makes of a byte: 0 parts tokens, 1 digit, 2 small letter, 3 capital, 4 dropped (with every byte of a character beyond ASCII).
KINDS = np.array([0 if chr(b) in DELIMITERS else 1 if 48 <= b <= 57 else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 for b in range(256)], np.uint8)
#: Bytes of texts that it takes at a time; a longer text is taken whole.
TEXT_BYTES = 1 << 20


def tokens_of(texts: pa.Array, most: int = MAX_TOKENS) -> pa.ListArray:
    """The same as ``tokenize`` without abbreviations, for a column of an Arrow batch: whole columns of bytes at a time."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    _, bounds, data = texts.buffers()
    ends = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data or b"", np.uint8)
    found, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, "right")) - 1)
        found.append(_tokens(whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at], most))
        at = to
    counts = np.concatenate([n for n, _ in found])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.concat_arrays([t for _, t in found]))


def _tokens(data: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, pa.Array]:
    """Number of tokens of each text, and all tokens; text i is data[ends[i]:ends[i + 1]]."""
    kind = KINDS[data]
    nuls = np.flatnonzero(data == 0)
    for end, nul in zip(*np.unique(np.searchsorted(ends, nuls, "right"), return_index=True), strict=True):
        kind[nuls[nul] : ends[end]] = 0
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    parts = kind == 0
    parts[firsts] = True
    if len(kind) > 1:
        before, capital = kind[:-1], kind[1:] == 3
        small = np.zeros(len(kind), bool)  # a small letter of the same text follows
        small[:-1] = kind[1:] == 2
        small[firsts[1:] - 1] = False
        parts[1:] |= capital & ((before == 1) | (before == 2) | (before == 3) & small[1:])
    kept = np.flatnonzero((kind > 0) & (kind < 4))
    if not len(kept):
        return np.zeros(len(ends) - 1, np.int64), pa.array([], pa.string())
    part = np.cumsum(parts, dtype=np.int64)[kept]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    stops = np.append(starts, len(kept))
    size = np.diff(stops)
    text = np.searchsorted(ends, kept[starts], "right") - 1
    fits = (size >= MIN_TOKEN_LENGTH) & (size <= MAX_TOKEN_LENGTH)
    n = np.bincount(text[fits], minlength=len(ends) - 1)
    fits[np.flatnonzero(fits)[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) >= most]] = False
    letters = data[kept] | np.where(kind[kept] == 3, np.uint8(32), np.uint8(0))
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(letters))
    return np.minimum(n, most), words.filter(pa.array(fits))


def expand(tokens: Column, most: int = MAX_TOKENS) -> Column:
    """Tokens, then what each abbreviation among them stands for, once per occurrence."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    short = F.filter(tokens, lambda t: t.isin(list(ABBREVIATIONS)))  # a hash lookup; the map is searched for hits only
    return F.slice(F.concat(tokens, F.transform(short, lambda t: F.element_at(table, t))), 1, most)


def proximity(a: Column, b: Column) -> Column:
    """1 + 0.1 x (leading directories in common) / (most slashes + 1); 1 for null or paths without a slash.

    A directory is a part before a slash. An empty first part on both sides ends the comparison,
    so absolute paths have none in common.
    """
    parts = lambda p: F.split(p, "/")
    dirs = lambda p: F.slice(parts(p), 1, F.greatest(F.size(parts(p)) - 1, F.lit(0)))
    same = F.zip_with(dirs(a), dirs(b), lambda x, y: F.coalesce((x == y) & (F.length(x) > 0), F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    most = F.greatest(F.size(dirs(a)), F.size(dirs(b)))
    return F.when(a.isNull() | b.isNull() | (most == 0), F.lit(1.0)).otherwise(1.0 + shared / (most + 1) * PROXIMITY_BOOST)


def chunks(content: Column, size: int) -> Column:
    """Byte strings of at least ``size`` bytes that end behind the next ``}``, or with the file."""
    if not 0 < size <= CHUNK_CAP:
        raise ValueError(f"a chunk has 1 to {CHUNK_CAP} bytes, not {size}")
    # ISO-8859-1 makes a byte a character, so that positions are bytes
    text = F.decode(content, "ISO-8859-1")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}[^}}]*\\}}?|.+"), F.lit(0))
    return F.transform(pieces, lambda p: F.encode(p, "ISO-8859-1"))
