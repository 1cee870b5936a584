import hashlib
import zlib
from collections import defaultdict

import pytest

from themeflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    by_source = defaultdict(list)
    for i, row in enumerate(rows):
        by_source[row[1]].append(((row[0] is not None, row[0] or 0), leaf_of(row), i))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for _, leaf, _ in sorted(by_source[s])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for nth, s in enumerate(sources):
        for pos, (_, leaf, i) in enumerate(sorted(by_source[s])):
            row, folded, beside = rows[i], leaf, []
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf_of(row[:4] + (row[4].translate({c: c + 32 for c in range(65, 91)}),))
            for tree, at in ((trees[s], pos), (top, nth)):
                for level in tree[:-1]:
                    run, own = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
                    beside += run[:own] + run[own + 1:]
                    folded, at = digest(*run[:own], folded, *run[own + 1:]), at // 16
            root = top[-1][0]
            yield row[0], leaf, trees[s][-1][0], root, digest(*beside), folded, folded == root


def verified(df):
    return sorted(map(tuple, merkle.verify_leaves(merkle.build_manifest(merkle.leaves_of(df))).collect()), key=str)


ODD = ([(i, None if i % 7 == 0 else f"s{i % 3}" if i % 40 else f"é{i}", None if i % 5 else "en", i,
         (None, "", "Ab C é", "x")[i % 4]) for i in range(700)] + [(5, "s0", "en", 1, "Dup")] * 3
       + [(None, "s1", None, None, None), (None, None, None, None, "A")])


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(i, "a", "l", 1, "T") for i in range(15)],
                                  [(i, f"a{i}", "l", 1, "T") for i in range(18)]],
                         ids=["odd", "one", "one run", "lone leaves"])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS leaf", "2 AS nth", "3 AS n", "4 AS sid")
    assert verified(df) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    df = merkle.verify_leaves(merkle.build_manifest(merkle.leaves_of(spark.createDataFrame([], SCHEMA))))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.count() == 0


def test_settings_of_the_recursion_are_put_back(spark):
    before = [spark.conf.get(key) for key in merkle._CLIMB_CONF]
    verified(spark.createDataFrame(ODD[:30], SCHEMA))
    assert [spark.conf.get(key) for key in merkle._CLIMB_CONF] == before


def test_a_tampered_row_is_found(spark):
    """Rows whose text has no capital letter stay as they are."""
    rows = [(i, "s", "en", 1, "Text" if i % 2 else "text") for i in range(100)]
    bad = {r[0] for r in verified(spark.createDataFrame(rows, SCHEMA)) if not r[6]}
    assert bad == {i for i in range(1, 100, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
