import random
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts
from wellspark.llm import queries, spelling

SF_DIR = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def links_of(words):
    """All near words of each word, by the words' texts with one place left out."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    found = defaultdict(set)
    for rest, some in holes.items():
        for a in some | ({rest} if rest in words else set()):
            for b in some | ({rest} if rest in words else set()):
                if near(a, b):
                    found[a].add(b)
    return found


def expected(words):
    links, form = links_of(words), {}
    for w in words:
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form.get(root):
            root = form[root]
        out.add((w, form[w], root, words[w], len(links[w]), words[form[w]] if form[w] else None))
    return out


def counted(pairs):
    words = Counter()
    for doc, text in pairs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def variants(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def frame(spark, words):
    return spark.createDataFrame([*words.items()], "word string, n bigint").repartition(3)


def made_words(seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abéz") for _ in range(rng.randint(1, 11)))
        words[w] = rng.choice((2, 30, 400, 5000))
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            words[rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abçÿ") + w[i + 1 :], w[:i] + "b" + w[i:])) or "a"] = rng.randint(2, 60)
    return words


@pytest.mark.parametrize("block,one_in,longest", [(3, 8192, 4096), (1, 20, 4), (2, 5, 2), (3, 40, 3)])
def test_groups_equal_brute_force(spark, block, one_in, longest):
    words = made_words(block * one_in)
    found = variants(spelling.group_variants(frame(spark, words), block=block, one_in=one_in, longest=longest))
    assert len(found) == len(set(found)) and set(found) == expected(words)


def test_a_list_that_all_words_share(spark):
    rng = random.Random(5)
    words = {f"common{''.join(rng.choice('xyz') for _ in range(3))}tail": 2 + i for i in range(60)}
    words |= {"commontail": 900, "commonxtail": 9, "commonxtails": 90}
    found = spelling.group_variants(frame(spark, words), longest=5)
    assert set(variants(found)) == expected(words)


def test_decomposition_depends_on_its_own_characters():
    frequent = {"ab", "abc", "bc"}
    assert spelling.decompose("abcabd", frequent) == [4, 4, 4, 6, 6]
    keys = spelling.index_keys("abcabd", frequent)
    assert [p for _, p in keys] == [0, 1, 6, 7, 13] and len({k for k, _ in keys}) == 5


def test_words_of_documents(spark):
    more = [(None, "CAFÉteria × cafÉteria÷Straßenbahn STRASSENBAHN x", "en", "s", 1, "r", "s", "f", "k", "t")] * 2
    docs = documents(spark, [WITHOUT_ID, rows()[0], *more])
    pairs = [*texts().items(), WITHOUT_ID[:2], (0, texts()[0]), *[(None, more[0][1])] * 2]
    runs = spelling.runs_of_letters(docs)
    words = spelling.count_words(runs.select(spelling.misspelt(F.col("row_id"), F.col("run")).alias("word")))
    found = {r["word"]: r["n"] for r in words.collect()}
    assert found == counted(pairs)
    assert set(variants(spelling.group_variants(words))) == expected(found)


def test_query_equals_brute_force(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = variants(queries.QUERIES["op11_gram_variants"](spark, SF_DIR))
    assert set(found) == expected(counted(pairs)) and len(found) == len(set(found))


def test_nothing(spark):
    words = spelling.count_words(spelling.runs_of_letters(nothing(spark)).withColumnRenamed("run", "word"))
    assert variants(spelling.group_variants(words)) == []
