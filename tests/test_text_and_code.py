import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import chunking, code
from loomspark.functions import text as T
from loomspark.functions.udfs import strip_code


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,tokens", [("", 0), ("ab", 2), ("a b c d e f", 8), ("x" * 36, 10)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.estimate_tokens, text) == tokens


def test_words_keep_case_of_non_ascii_and_drop_stop_words(spark):
    assert one(spark, T.tokenize_words, "The Parse_Token x é of") == ["parse_token", "é"]


def test_whitespace_and_lines(spark):
    assert one(spark, T.normalize_whitespace, "  a   b\t\n c ") == "a b c"
    assert one(spark, T.lines, "a\r\nb\n\n") == ["a", "b", ""]
    assert one(spark, T.lines, "") == []
    assert one(spark, T.line_shingles, " a \n\nb\nc\nd") == ["a\nb\nc", "b\nc\nd"]
    assert one(spark, T.line_shingles, "\n \n") == []
    assert one(spark, lambda c: T.line_shingles(c), "only") == ["only"]


@pytest.mark.parametrize("path,lang", [("a/b.rs", "rust"), ("x.TS", "typescript"), ("q.PY", "python"), ("x.xyz", "unknown"), ("noext", "unknown"), (".json", "json"), ("a.", "unknown"), (None, "unknown")])
def test_language(spark, path, lang):
    assert one(spark, T.language_of_path, path) == lang


def test_patterns_drop_docstrings_and_lexer_keeps_them(spark):
    src = 'def f():\n    """doc"""\n    x = "# no"  # yes\n    print("hi")\n    return x\n'
    assert code.strip_exact(src, "python") == 'def f():\n    """doc"""\n    x = "# no"  \n        return x\n'
    assert '"""' not in one(spark, lambda c: T.strip_by_patterns(c, F.lit("python")), src)
    got = one(spark, lambda c: strip_code(c, F.lit("python")), src)
    assert got == 'def f():\n    """doc"""\n    x = "# no"\n        return x'
    assert one(spark, lambda c: strip_code(c, F.lit("python")), "def broken(:\n  x # c\n") == "def broken(:\n  x"


def test_c_like_lexer():
    js = 'let u = `http://${a /* c */}`; // gone\nconst r = /\\/\\/x/; console.log("// no"); keep();\n'
    assert code.strip_exact(js, "javascript") == 'let u = `http://${a }`; \nconst r = /\\/\\/x/; keep();\n'
    rs = 'fn a() { let s = r#"// "quoted""#; /* x /* y */ z */ println!("{}", s); b(\'"\') }'
    assert code.strip_exact(rs, "rust") == 'fn a() { let s = r#"// "quoted""#;  b(\'"\') }'


def test_skeletons():
    ts = "import x from 'y';\nexport class A {\n  go(): void { inner(); }\n  stop(n: number) { other(); }\n}\n"
    got = code.skeleton(ts, "typescript")
    assert "go(): void { /* … */ }" in got and "stop(n: number)" in got and "inner" not in got and "import x" in got
    rs = "pub fn f(a: u8) -> u8 {\n  let b = a;\n  b\n}\n"
    assert code.skeleton(rs, "rust") == "pub fn f(a: u8) -> u8 { /* … */ }\n"
    assert code.skeleton("x = 1\n", "python") is None and code.skeleton("{}", "json") is None


def test_symbols():
    rows = code.symbols("class A(B):\n    def m(self):\n        return os.path.join(f(1))\n\ndef g():\n    import re\n    A().m()\n", "python", "p.py")
    by = {r["qualified"]: r for r in rows}
    assert by["p.py::A"]["bases"] == ["B"] and by["p.py::A::m"]["kind"] == "method" and sorted(by["p.py::A::m"]["calls"]) == ["f", "join"]
    assert sorted(by["p.py::g"]["calls"]) == ["A", "m"] and "p.py::import::import re" in by


def slow_cut(b, low, high, bits):
    m, rows = (1 << 64) - 1, [int(x) for x in chunking.byte_values()]
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & m if k else x
    out, start, h = [], 0, 0
    if len(b) <= low:
        return [(0, len(b))] if b else []
    for i, c in enumerate(b):
        h = turn(h, 1) ^ rows[c] ^ (turn(rows[b[i - 48]], 48) if i >= 48 else 0)
        if i - start + 1 >= high or (i - start + 1 >= low and not h & ((1 << bits) - 1)):
            out.append((start, i + 1))
            start, h = i + 1, 0
    return [*out, (start, len(b))] if start < len(b) else out


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 80), st.integers(2, 6))
def test_chunking_equals_the_byte_loop(data, low, bits):
    assert chunking.cut(data, low, low * 4, bits) == slow_cut(data, low, low * 4, bits)


def test_chunks_cover_and_stay_local():
    data = np.random.default_rng(1).integers(0, 256, 240_000, dtype=np.uint8).tobytes()
    a, b = chunking.cut(data), chunking.cut(data[:30_000] + b"inserted bytes..." + data[30_000:])
    assert a[0][0] == 0 and a[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(a, a[1:]))
    assert sum(x == y for x, y in zip(a, b)) >= 2


ODD = """import os
from pkg import a  # é
@deco(1)
# between
@other
class C(Base, metaclass=M):
    QQQdoc
def no(): pass
QQQ
    def m(self):
        import late
        return f(g(1))  # x
if os:
    print("a")
else:
    print('b # no')
try:
    x = (1,
2)
except E:
    pass
finally:
    print(QQQ
def neither(): print(1)
QQQ)
async def h%d(x): return h(x) ; print(2)
for é in k(): y = \\
1
else: pass
""".replace("QQQ", "'''")


def test_python_in_pieces_reads_as_a_whole(monkeypatch):
    s = "".join(ODD.replace("%d", str(i)) for i in range(30))
    whole = code.strip_exact(s, "python"), code.skeleton(s, "python"), code.symbols(s, "python", "a.py")
    monkeypatch.setattr(code, "PIECE", 40, raising=False)
    code._cuts.cache_clear()
    assert len(code._cuts(s)) > 100
    assert (code.strip_exact(s, "python"), code.skeleton(s, "python"), code.symbols(s, "python", "a.py")) == whole
    for bad in ("x = (\n", "def f(:\n  pass\n", "  y = 1\n"):
        assert code.strip_exact(s + bad, "python") is None and code.items(s + bad, "python") is None


def test_long_python_takes_little_memory():
    s = "".join(f"def f{i}(x):\n    print('# x')\n    return f{i + 1}(x)  # call\n\n\n" for i in range(12_000))
    for read in (code.strip_exact, code.skeleton):
        tracemalloc.start()
        assert read(s, "python")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 * len(s)
