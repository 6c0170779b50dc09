"""Small tables with every odd case, shared by the operators' tests."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "id long, row string, hash int, text_hash long, size int, n int, words string, norm string, part int")


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gamma", "delta,", "été", "zeta", "Ωmega", "x1", "theta", "iota"]) for _ in range(n)]


def rows(seed=1, n=40):
    """Documents with nulls, empty and very long texts, copies that differ in case, near copies,
    shared passages, repeated rows and odd white space."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(n)]
    texts += [None, "", " \t\n", "one", "One", "one two", passage, passage + " end", passage.upper(), passage,
              texts[0].upper(), texts[0].lower(), "tail " + passage + " more " + passage,
              "a b c\x1cd\x85e", "'s we'll  don't   stop\n\n\nnow   ", "<|endoftext|> <|startoftext|> a|b | ||",
              " ".join(words(rng, 30_000)), "\U0001f600 漢字 é é ½ ²"]
    near = words(rng, 80)
    for k in range(6):
        copy = list(near)
        copy[10 * k] = f"changed{k}"
        texts.append(" ".join(copy))
    out = []
    for i, t in enumerate(texts):
        source = [None, "a", "b", "é", "B"][i % 5]
        out.append((i, t, None if i % 7 == 0 else "en", source, None if t is None else len(t),
                    i * 10, "r", 5, 7, i, 1, "w", None, 0))
    out.append(out[3])  # a repeated row
    out.append((None, "no identifier", "en", "a", 13, *[None] * 9))
    out.append((None, None, None, None, None, *[None] * 9))
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def as_rows(df):
    return [tuple(r) for r in df.collect()]
