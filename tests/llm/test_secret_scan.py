import random
import re

from ledgerlens.llm import secret_scan as S

from .cases import SCHEMA, as_rows, docs, rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(3)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    b62 = "".join(rng.choice(S.ALPHABETS["base62"]) for _ in range(40))
    return [None, "", f'é token = "{hexes}" x', "password: short", "API_KEY=abcdef", "apikey='abc.def' passwd = ab token=zzzzzz",
            "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 14, hexes, hexes.upper(), "f" * 23, "0" * 24, "toKEN:x=yzzzzz",
            f"\U0001f600 key {b62} and then some more words follow here so that a decoy of that length can be found in the text itself",
            "a_very_long_name_of_a_file_2024_final_version " * 3, "ſecret=abcdefgh", "toKen=abcdefgh", "secret = token = abcdefg"]


def test_base_spans_match_brute_force(spark):
    data = [(i, t, *[None] * 12) for i, t in enumerate(texts())] + rows()
    got = S.find_secrets(docs(spark, data))
    want = sorted((str(r[0]), [tuple(x) for x in base(r[1] or "")]) for r in data)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.spans if x.kind < 3]) for r in got.collect()) == want


def test_random_strings_are_found_and_names_are_not(spark):
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in S.find_secrets(
        docs(spark, [(i, t, *[None] * 12) for i, t in enumerate(texts())])).collect()}
    assert spans[14] == [(6, 3, 46)] and spans[15] == [] and spans[10] == [(0, 3, 40)]


def test_randomness_separates(spark):
    rng = random.Random(7)
    for name, alphabet in S.ALPHABETS.items():
        k = len(alphabet)
        scores = [S.randomness([rng.randrange(k) for _ in range(40)], k) for _ in range(400)]
        assert sum(s >= S.LEAST_P for s in scores) >= 380, name
        assert S.randomness([i % k for i in range(64)], k) < S.LEAST_P  # even, but in order
        assert S.randomness([0, k - 1] * 20, k) < S.LEAST_P


def test_inferred_encodings():
    for run, want in (("0123456789abcdef0123", "hex"), ("ABCDEF0123456789ABCD", "HEX"), ("MZXW6YTBOI2345677777", "base32"),
                      ("zz9zz9zz9zz9zz9zz9zz", "base36"), ("aB3" * 7, "base62"), ("aB3+" * 5, "base64"), ("aB3-" * 5, "base64url"),
                      ("a" * 20, None), ("1" * 20, None), ("aB3+-" * 5, None)):
        assert S.infer_encoding(run) == want


def test_false_discovery_control(spark):
    """Where natural text scores as high as the candidates, none is accepted."""
    c = [{"start": 0, "end": 20, "encoding": "hex", "band": 5, "score": 0.5, "decoy": d} for d in (0.9, 0.9, 0.001)]
    df = spark.createDataFrame([(1, [], c)], f"id long, base {S._SPAN}, candidates {S._CANDIDATE}")
    assert as_rows(S.least_scores(df)) == []
    c = [dict(x, decoy=0.001) for x in c]
    df = spark.createDataFrame([(1, [], c)], f"id long, base {S._SPAN}, candidates {S._CANDIDATE}")
    assert as_rows(S.least_scores(df)) == [("hex", 5, 0.5)]


def test_text_form_and_empty(spark):
    df = docs(spark, [(1, "x token=abcdef", *[None] * 12)])
    assert as_rows(S.find_secrets(df).select(S.as_text("spans"))) == [("assign:2:14",)]
    assert as_rows(S.find_secrets(spark.createDataFrame([], SCHEMA))) == []


def test_tokens_inside_longer_runs_are_found(spark):
    """NAME=token, a token in a path, what a base span leaves of a run, and a token without a digit."""
    rng = random.Random(11)
    tail = " and then some more words follow here so that a decoy of that length can be found in the text itself"
    made, want = [], []
    for i in range(200):
        before, after, alphabet = [("auth=", "", "base62"), ("/v1/files/", "_x", "base62"), ("f" * 24, "", "base64url"),
                                   ("key ", "", "letters")][i % 4]
        alphabet = S.LOWER + S.UPPER if alphabet == "letters" else S.ALPHABETS[alphabet]
        token = "G" + "".join(rng.choice(alphabet) for _ in range(39))
        made.append((i, before + token + after + tail, *[None] * 12))
        want.append((len(before), len(before) + len(token)))
    spans = {int(r.doc_id): r.spans for r in S.find_secrets(docs(spark, made)).collect()}
    for kind in range(4):
        hits = [any(x.kind == 3 and x.start <= s and e <= x.end for x in spans[i])
                for i, (s, e) in enumerate(want) if i % 4 == kind]
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits))
    for found in spans.values():  # overlapping candidates become one span
        found = [x for x in found if x.kind == 3]
        assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def test_base64_and_base64url_are_cut_apart():
    rng = random.Random(5)
    token = "".join(rng.choice(S.ALPHABETS["base62"]) for _ in range(30))
    text = f"x/{token}_y"
    got = {(c["start"], c["end"], c["encoding"]) for c in S.candidates(text, [])}
    assert got == {(0, 32, "base64"), (2, 34, "base64url"), (2, 32, "base62")}
    assert [(c["start"], c["end"]) for c in S.candidates("k=" + token, [])] == [(2, 32)]
    assert [(c["start"], c["end"]) for c in S.candidates(token + token, [(25, 2, 30)])] == [(0, 25), (30, 60)]


def test_dumps_of_tokens_are_found(spark):
    """Lists of 1, 8 and 100 random tokens a document, alone and between lines of prose; prose itself stays clean."""
    rng = random.Random(21)
    vocabulary = ["and", "then", "some", "more", "words", "follow", "here", "so", "that", "it", "reads", "like", "text"]

    def prose():
        return " ".join(rng.choice(vocabulary) for _ in range(12))
    made, want = [], {}
    for i, n in enumerate([1] * 30 + [8] * 30 + [100] * 5):
        lines, at, places = [], 0, []
        for _ in range(n):
            if i % 2:
                lines.append(prose())
            token = "".join(rng.choice(S.ALPHABETS["base62"]) for _ in range(32))
            lines.append(("KEY_%d=" % len(places) if i % 3 == 0 else "") + token)
            places.append(token)
        text = "\n".join(lines)
        made.append((i, text, *[None] * 12))
        want[i] = [(text.index(t), text.index(t) + 32) for t in places]
    clean = [(1000 + i, "\n".join(prose() for _ in range(30)) + " a_rather_long_name_of_some_file_version_two", *[None] * 12) for i in range(60)]
    spans = {int(r.doc_id): [x for x in r.spans if x.kind == 3] for r in S.find_secrets(docs(spark, made + clean)).collect()}
    for size in (1, 8, 100):
        for mixed in (0, 1):
            of = [(i, s, e) for i, places in want.items() if len(places) == size and i % 2 == mixed for s, e in places]
            hits = [any(x.start <= s and e <= x.end for x in spans[i]) for i, s, e in of]
            assert sum(hits) >= 0.9 * len(hits), (size, mixed, sum(hits), len(hits))
    found = sum(len(x) for x in spans.values())
    false = sum(len(spans[i]) for i, *_ in clean)
    assert false <= S.FALSE_DISCOVERIES * found


def test_decoys_leave_out_candidates():
    text = "AbCdEfGhIjKlMnOpQrStUvWx plain words " + "ZyXwVuTsRqPoNmLkJiHg" + " end of it all"
    ground = S.Ground(text, [m.span() for m in S.CANDIDATE.finditer(text)])
    assert ground.decoy("base62", 24, 20) == "plainwordsendofitall"
    assert ground.decoy("base62", 60, 12) == "dofitallplai" and ground.decoy("base62", 0, 21) is None
