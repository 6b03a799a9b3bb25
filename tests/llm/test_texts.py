"""Operators on texts against plain versions."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import by_row, documents, none, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_rules(spark):
    from tidewater.llm.quality_rules import quality_rules

    got = quality_rules(documents(spark))
    plain = []
    for r in documents(spark).collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if triples[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        plain.append((r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), base))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(got, *columns) == sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert not got.where("base_failed and kept").count()
    assert quality_rules(none(spark)).count() == 0


def test_quality_shares():
    from tidewater.llm.quality_rules import DUPLICATE_NGRAM_SHARE, TOP_NGRAM_SHARE, measure

    for text in texts():
        w, m = WORD.findall(text or ""), measure(text)
        chars = sum(map(len, w))
        for n in DUPLICATE_NGRAM_SHARE:
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            seen = Counter(grams)
            inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)}
            assert m["dup_ngram_share"][n] == pytest.approx(sum(len(w[i]) for i in inside) / max(chars, 1))
        for n in TOP_NGRAM_SHARE:
            seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            most = max(seen.values(), default=0)
            best = max((sum(map(len, g)) * c for g, c in seen.items() if c == most), default=0) if most > 1 else 0
            assert m["top_ngram_share"][n] == pytest.approx(best / max(chars, 1))


def plain_fingerprint(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(spark):
    from tidewater.llm.simhash import simhash_groups

    docs = documents(spark)
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[root].append(r["doc_id"])
    want = [(r["doc_id"], f"{p:016x}", min(least[root], default=None)) for r, p, root in zip(rows, prints, roots, strict=True)]
    assert by_row(simhash_groups(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert simhash_groups(none(spark)).count() == 0


@pytest.mark.parametrize(("width", "plain", "together"), [(2, 32, 2048), (3, 2, 3), (4, 0, 5), (5, 1, 2)])
def test_pigeonhole_search_is_complete(spark, width, plain, together, monkeypatch):
    from tidewater.llm import simhash
    from tidewater.llm.shared import Scratch

    rng = np.random.default_rng(width)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    base[20:40] = base[0]  # a dense group
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 7), replace=False).astype(np.uint64)) for _ in base], dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips])).view(np.int64).tolist()
    monkeypatch.setattr(simhash.Plan, "best_width", lambda self: width)
    monkeypatch.setattr(simhash, "PLAIN", plain)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    scratch = Scratch(spark, "test")
    links = simhash.fingerprint_components(scratch.save(spark.createDataFrame([(x,) for x in fps], "fp long"), "fps"), scratch)
    got = {x: x for x in fps} | {r["node"]: r["component"] for r in links.collect()}
    roots = plain_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = defaultdict(set)
    for x, r in zip(fps, roots, strict=True):
        groups[r].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x for x in fps if got[x] == r) for r in set(got.values())}


def test_bucket_of_near_copies(spark, monkeypatch):
    """Candidates of one large group grow with its size and not with the square of it, and no link is lost."""
    from tidewater.llm import simhash
    from tidewater.llm.shared import Scratch

    rng, counted, real = np.random.default_rng(5), [], simhash.candidates
    copies = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(5000)], dtype=np.uint64)
    fps = np.unique(np.concatenate([copies ^ np.uint64(0x123456789ABCDEF1), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)]))

    def counting(index, probes):
        out = real(index, probes)
        counted.append(out.count())
        return out

    monkeypatch.setattr(simhash, "candidates", counting)
    scratch = Scratch(spark, "test")
    table = scratch.save(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"), "fps")
    got = {x: x for x in fps.view(np.int64).tolist()} | {r["node"]: r["component"] for r in simhash.fingerprint_components(table, scratch).collect()}
    assert counted[0] < 20 * len(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 4)]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(set)
    for i, x in enumerate(fps.view(np.int64).tolist()):
        groups[find(i)].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x for x in xs) for xs in _by_root(got).values()}


def _by_root(got):
    out = defaultdict(set)
    for x, r in got.items():
        out[r].add(x)
    return out


def test_keep_one(spark):
    from tidewater.llm.simhash import keep_one, simhash_groups

    docs = documents(spark)
    kept, groups = keep_one(docs), simhash_groups(docs)
    assert kept.columns == docs.columns
    prints = {r["fingerprint"] for r in simhash_groups(kept).select("fingerprint").collect()}
    assert len(prints) == kept.count() == groups.select("component_id", "fingerprint").groupBy("component_id").count().count()
    assert keep_one(none(spark)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    from tests.llm.fixtures import words
    from tidewater.llm.simhash import keep_one

    rng = random.Random(8)
    a, b, c = (words(rng, 90) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (0, c), (1, c), (1, b)]  # two texts under one doc_id; copies; a doc_id that is a choice in one group only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect())) == sorted([(1, a), (1, b), (0, c)])


def test_near_duplicates_stage_is_complete(spark):
    import corpus_pipeline
    from tests.llm.fixtures import words
    from tidewater.llm import similar

    rng, rows = random.Random(4), list(texts())
    shared = words(rng, 60)
    for k in range(12):  # chains of ever farther copies, and a passage in unlike texts
        base = words(rng, 150).split()
        for _ in range(6):
            base = [w if rng.random() > 0.01 * k else "changed" for w in base]
            rows.append(" ".join(base))
        rows.append(words(rng, 90) + " " + shared + " " + words(rng, 90))
    sets = []
    for t in rows:
        w = similar.split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    roots = plain_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want = {min(i for i, q in enumerate(roots) if q == root) for root in set(roots)}
    assert got == want and len(want) < len(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def join_rows(spark, since=-1):
    """The rows that each join of the session's executions after one of that id made, and the last id."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, found, last = store.executionsList(), [], since
    for i in range(runs.size()):
        key = runs.apply(i).executionId()
        last = max(last, key)
        if key <= since:
            continue
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            for m in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    found.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return found, last


def test_near_duplicates_make_no_square_of_a_dense_group(spark):
    """Near copies around the least similarity: joins make a few rows for each, and the groups are those of all pairs."""
    import corpus_pipeline
    from tests.llm.fixtures import words
    from tidewater.llm import similar

    rng = random.Random(6)
    base, rows = words(rng, 150).split(), []
    for k in range(240):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3))):
            copy[at] = f"changed{k}x{at}"
        rows.append(" ".join(copy))
    sets = [set(similar.shingles(similar.split(t)).tolist()) for t in rows]
    roots = plain_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    since = join_rows(spark)[1]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {min(i for i, q in enumerate(roots) if q == root) for root in set(roots)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = join_rows(spark, since)[0]
    entries = sum(len(x) - -(-4 * len(x) // 5) + 1 for x in sets)
    assert made and max(made) <= entries < len(rows) ** 2 / 2


def test_parities_bound_the_difference():
    from tidewater.llm.similar import PARITIES, parities

    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 300, 5000):
        pool = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        for share in (0.5, 0.9, 1.0):
            x, y = (pool[rng.random(len(pool)) < share] for _ in range(2))
            a, b = parities(x), parities(y)
            assert len(a) == PARITIES and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_scratch_tables_take_few_bytes_at_a_time(spark):
    """A task holds a batch of a few MB, in the JVM and in Python, however long the texts; the session's setting stays."""
    from tidewater.llm.shared import BATCH_BYTES, Scratch, map_batches

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = Scratch(spark, "sizes").save(map_batches(texts, sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in found) == 4000
    assert max(r["bytes"] for r in found) <= BATCH_BYTES + 3 * 4004
    assert spark.conf.get(name) == was


def test_components(spark):
    from tidewater.llm.components import components
    from tidewater.llm.shared import Scratch

    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 200)] + rng.integers(0, 60, (40, 2)).tolist() + [(7, 7), (None, 3), (500, 499), (499, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    nodes = sorted({x for a, b in links if a is not None and a != b for x in (a, b)})
    pairs = {frozenset(p) for p in links if None not in p}
    roots = plain_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    least = {r: min(n for n, q in zip(nodes, roots, strict=True) if q == r) for r in roots}
    assert got == {n: least[r] for n, r in zip(nodes, roots, strict=True)}


def plain_ids(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(spark):
    from tidewater.llm.shared import Scratch
    from tidewater.llm.token_orc import look_up, read_token_files, token_digest, write_token_files

    docs = documents(spark)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_digest(docs).collect()}
    at, order = 0, sorted(got, key=lambda k: k[1])
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(plain_ids(r["text"], 0))
    assert [k[0] for k in order] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: -1 if d is None else d)
    for key in order:
        assert key[1] == at
        assert got[key] in [(len(x), crc(x)) for x in ids[key[0]]]
        at += got[key][0]
    path = Scratch(spark, "test").new_path("orc")
    write_token_files(docs, path)
    assert {tuple(r["ids"]) for r in look_up(spark, path, [9]).collect()} == {tuple(ids[9][0])}
    assert read_token_files(spark, path).count() == docs.count()
    assert token_digest(none(spark)).count() == 0


def test_token_file_format(spark, tmp_path):
    """Integer run-length encoding of the second version, row indexes, a Bloom filter on doc_id, and look-ups that use them."""
    from tidewater.llm.token_orc import look_up, write_token_files

    path = f"file://{tmp_path}/orc"
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    write_token_files(docs, path)
    jvm, files = spark.sparkContext._jvm, [f for f in os.listdir(f"{tmp_path}/orc") if f.endswith(".orc")]
    assert files
    for name in files:
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), options)
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        footer = reader.rows().readStripeFooter(reader.getStripes()[0])
        assert {footer.getColumns(c).getKind().toString() for c in range(1, footer.getColumnsCount())} == {"DIRECT_V2"}
        streams = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
        assert (1, "ROW_INDEX") in streams and (1, "BLOOM_FILTER_UTF8") in streams

    def scanned(df):
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        plan = leaves.head()
        return rows, plan.metrics().apply("numOutputRows").value()

    rows, read = scanned(look_up(spark, path, [1234]))
    assert [r["doc_id"] for r in rows] == [1234] and read <= 1024
    rows, read = scanned(look_up(spark, path, [1235]))  # between two ids: the Bloom filter knows
    assert rows == [] and read <= 1024


@pytest.mark.parametrize("with_ids", [False, True])
def test_packing(spark, with_ids):
    from tidewater.llm.packing import TIERS, pack_documents

    docs = documents(spark)
    rows = pack_documents(docs, with_ids=with_ids).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    padded = 0
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padded += at not in TIERS
    assert padded <= docs.rdd.getNumPartitions()
    want = Counter()
    for r in docs.collect():
        ids = plain_ids(r["text"], 1)
        want[r["doc_id"], len(ids)] += 1
        if want[r["doc_id"], len(ids)] == 1:
            for p in pieces[r["doc_id"], len(ids)]:
                part = ids[p["start"] : p["start"] + p["length"]]
                assert p["ids_crc32"] == crc(part)
                assert not with_ids or p["ids"] == part
    for key, n in want.items():
        assert sum(p["length"] for p in pieces[key]) == n * key[1]
    assert pack_documents(none(spark)).count() == 0


def test_step_groups_are_equal(spark):
    from tidewater.llm.packing import pack_documents

    for tokens in (4096, 1 << 14):
        groups, tasks = Counter(), defaultdict(list)
        rows = pack_documents(documents(spark).repartition(2), step_tokens=tokens).select("sequence_id", "tier", "step_group").distinct().collect()
        for r in rows:
            groups[r["step_group"]] += r["tier"]
        for g, n in groups.items():
            tasks[g >> 36].append(n)
        assert len(tasks) == 2 and all(sorted(ns, reverse=True)[:-1] == [tokens] * (len(ns) - 1) and min(ns) <= tokens for ns in tasks.values())


def plain_pieces(v, text):
    s = " " + text if text else ""
    best, n = [0.0] + [-1e99] * len(s), [0] * (len(s) + 1)
    for i in range(1, len(s) + 1):
        for k in range(max(0, i - v.longest), i):
            if (q := v.score.get(s[k:i])) is not None and best[k] + q > best[i] + 1e-12:
                best[i], n[i] = best[k] + q, n[k] + 1
        if s[i - 1] not in v.score:
            size = len(s[i - 1].encode())
            if best[i - 1] + size * v.byte_score > best[i] + 1e-12:
                best[i], n[i] = best[i - 1] + size * v.byte_score, n[i - 1] + size
    return n[-1]


def test_token_counts(spark):
    from tidewater.llm.unigram import Trie, token_counts, vocabulary

    docs, v = documents(spark), vocabulary()
    want = sorted(((r["doc_id"], plain_pieces(v, r["text"] or "")) for r in docs.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert by_row(token_counts(docs), "doc_id", "n_tokens") == want
    trie = Trie(v)
    for w in (" there", " then", " the", " there"):
        trie.insert(w)
    assert trie.computed == len(" there") + 1  # shared prefixes once
    assert token_counts(none(spark)).count() == 0


def test_segmentations(spark):
    from tidewater.llm.gumbel_pieces import decode_pieces, sample_segmentations
    from tidewater.llm.unigram import vocabulary

    docs = documents(spark)
    rows = sample_segmentations(docs, with_ids=True)
    v, found = vocabulary(), defaultdict(list)
    for r in rows.collect():
        found[r["doc_id"]].append(r)
        assert r["round_trip"] and 0 < r["inclusion"] <= 1
    text = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    for d, t in text.items():
        own = {tuple(r["ids"]) for r in found[d]}
        assert all(v.decode(ids) == t for ids in own)
        assert len(own) == len({r["rank"] for r in found[d]})
    assert {r["text"] for r in decode_pieces(rows.where("doc_id = 12").select("doc_id", "ids")).collect()} == {text[12]}
    again = sample_segmentations(docs.repartition(3))
    assert by_row(again, "doc_id", "rank", "ids_crc32") == by_row(rows, "doc_id", "rank", "ids_crc32")
    assert sample_segmentations(none(spark)).count() == 0


def test_no_segmentation_is_left_out():
    from tidewater.llm.gumbel_pieces import piece_lattices, sample_texts
    from tidewater.llm.unigram import pre_tokens

    lattices = piece_lattices()
    table = lattices.table

    def count(s):
        ways = [1] + [0] * len(s)
        for end in range(1, len(s) + 1):
            ways[end] = sum(ways[at] for at in range(end) if s[at:end] in table.words.id_of or (end - at == 1 and s[at:end] not in table.words.id_of))
        return ways[-1]

    rows = [a + b for a in "AIax!.é☃日 " for b in ("", *"AIfon.!é☃")] + ["of", "in", "to", "! ! ! !", "A A A A A A", "internationalization", "☃" * 400 + " A"]
    for k in (1, 3, 9):
        for text, found in zip(rows, sample_texts(rows, list(range(len(rows))), lattices, k=k), strict=True):
            total = int(np.prod([float(count(t)) for t in pre_tokens(text)]).clip(0, 1e9))
            assert len(found) == min(k, total), (text, k)
            assert len({tuple(x["ids"].tolist()) for x in found}) == len(found)
            assert all(table.words.decode(x["ids"].tolist()) == text and np.isfinite(x["log_prob"]) for x in found)
            values = [x["perturbed"] for x in found]
            assert values == sorted(values, reverse=True)
            assert total <= k or k == 1 or all(x["inclusion"] <= 1 for x in found)
            assert total > k or all(x["inclusion"] == 1 for x in found)


def test_pre_tokens_are_cut_without_an_expression(monkeypatch):
    """Texts without runs of spaces are cut by plain splits, to the same pre-tokens as by the expression."""
    from tidewater.llm import unigram

    rng, rule, tried = random.Random(5), unigram._PRE, []

    class Counted:
        @staticmethod
        def findall(text):
            tried.append(text)
            return rule.findall(text)

    monkeypatch.setattr(unigram, "_PRE", Counted)
    odd = ["".join(rng.choice("ab \n\t\r\x0b\0é☃\u3000") for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [t or "" for t in texts()]
    for t in odd:
        assert unigram.pre_tokens(t) == (rule.findall(" " + t) if t else [])
    tried.clear()
    unigram.pre_tokens("one two\nthree \n\n four ")
    assert not tried


def test_trie_looks_up_endings_only():
    """Scores of random pre-tokens are those of all segmentations, and no look-up goes on where no piece ends so."""
    from tidewater.llm.unigram import Trie, vocabulary

    v, rng, asked = vocabulary(), random.Random(6), []

    class Asked(dict):
        def get(self, key):
            asked.append(key)
            return dict.get(self, key)

    assert set(v.endings) == {p[n:] for p in v.id_of for n in range(len(p))}
    trie = Trie(v)
    for _ in range(400):
        word = "".join(rng.choice("aeinrst.,é☃日") for _ in range(rng.randint(1, 20)))
        assert trie.insert(" " + word)[1] == plain_pieces(v, word)
    trie.words = type("Words", (), {"score": v.score, "byte_score": v.byte_score, "longest": v.longest, "endings": Asked(v.endings)})
    trie.insert("qxqxqxqxqxqxqxqx")
    assert all(x in v.endings or x[1:] in v.endings or len(x) == 1 for x in asked)


def test_lattices_are_weighed_once(monkeypatch):
    """New pre-tokens are numbered as they're met and built once, in rows of whole eights; what a slice repeats isn't built again."""
    from tidewater.llm import gumbel_pieces as g

    lattices, built = g.Lattices(g.piece_lattices().table), []
    monkeypatch.setattr(lattices, "_build", lambda new, f=lattices._build: (built.extend(new), f(new))[1])
    tokens = [" the", "x", " of", " the", "\n", " internationalization", "x"]
    assert lattices.places(tokens).tolist() == [0, 1, 2, 0, 3, 4, 1]
    assert lattices.places(tokens[::-1]).tolist() == [1, 4, 3, 0, 2, 1, 0]
    assert built == [" the", "x", " of", "\n", " internationalization"]
    assert lattices.hits.tolist() == [4, 4, 2, 2, 2] and lattices.width % 8 == 0
    for token, n in lattices.index.items():
        at = lattices.first[n]
        assert lattices.sizes[n] == len(token) and np.allclose(lattices.p[at : at + len(token)].sum(1), 1)
    rows = np.sort(np.random.default_rng(2).random((500, 16)), axis=1).astype(np.float32)
    u = np.append(rows[:250, 3], np.random.default_rng(3).random(250).astype(np.float32))
    assert g.passed(rows, u).tolist() == (rows <= u[:, None]).sum(1).tolist()


def test_lattice_rows_hold_edges_only():
    """A node's edges are side by side in rows of eight, which get wider for a node of more, and all are those of a plain backward sum."""
    from tidewater.llm import gumbel_pieces as g

    lattices = g.Lattices(g.piece_lattices().table)
    words = lattices.table.words

    def check(token):
        after, at = [0.0] * (len(token) + 1), lattices.first[lattices.index[token]]
        for i in reversed(range(len(token))):
            own = [(words.id_of[token[i:j]], j - i, words.score[token[i:j]] + after[j]) for j in range(i + 1, min(len(token), i + words.longest) + 1) if token[i:j] in words.id_of]
            if token[i] not in words.id_of:
                own.insert(0, (-2 - ord(token[i]), 1, len(token[i].encode()) * words.byte_score + after[i + 1]))
            after[i] = float(np.logaddexp.reduce([x for *_, x in own]))
            n, p = len(own), np.exp([x - after[i] for *_, x in own])
            assert lattices.id[at + i, :n].tolist() == [x for x, *_ in own] and lattices.size[at + i, :n].tolist() == [x for _, x, _ in own]
            assert np.allclose(lattices.p[at + i, :n], p) and not lattices.p[at + i, n:].any()
            assert np.allclose(lattices.upto[at + i, : n - 1], np.cumsum(p)[:-1]) and (lattices.upto[at + i, n - 1 :] == 2).all()

    tokens = [" the", "x", " segmentations", "é☃日😀a", " aieuxré.", "☃" * 400 + " A"]
    lattices.places(tokens)
    assert lattices.width == 8 and lattices.id.shape[1] == lattices.p.shape[1] == 8
    list(map(check, tokens))
    deepest = max(words.id_of, key=lambda p: sum(p[:n] in words.id_of for n in range(1, len(p) + 1)))
    more = [" internationalization", deepest, deepest * 3]
    lattices.places([*more, " the"])
    assert lattices.width == 16
    list(map(check, tokens + more))


def test_sets_are_weighed_once(monkeypatch):
    """The sets that leave a path are weighed once for all that are drawn, and again where what is left is far less likely."""
    from tidewater.llm import gumbel_pieces as g

    lattices, weighed = g.piece_lattices(), []

    class Counted:
        def __getattr__(self, name):
            return (lambda x: (np.ndim(x) and weighed.append(len(x)), np.exp(x))[1]) if name == "exp" else getattr(np, name)

    lattices.places(g.pre_tokens("one of the internationalization"))
    monkeypatch.setattr(g, "np", Counted())
    found = g.sample_texts(["one of the internationalization"] * 20, list(range(20)), lattices, k=3)
    assert all(len({tuple(x["ids"].tolist()) for x in f}) == 3 for f in found)
    assert len(weighed) == 3  # of the sets of the first, second and third paths


def test_gumbel_top_k_distribution():
    from tidewater.llm.gumbel_pieces import piece_lattices, sample_texts

    lattices = piece_lattices()
    table = lattices.table

    def segmentations(s):
        if not s:
            return [((), 0.0)]
        return [((table.words.id_of[s[:k]], *a), table.words.score[s[:k]] + b) for k in range(1, len(s) + 1) if s[:k] in table.words.score for a, b in segmentations(s[k:])]

    found = segmentations(" anon")
    total = sum(np.exp(b) for _, b in found)
    p = {a: np.exp(b) / total for a, b in found}
    n = 8000
    rows = sample_texts(["anon"] * n, list(range(n)), lattices, k=2)
    first = Counter(tuple(r[0]["ids"].tolist()) for r in rows)
    second = Counter(tuple(r[1]["ids"].tolist()) for r in rows)
    for a in p:
        assert abs(first[a] / n - p[a]) < 0.02
        assert abs(second[a] / n - sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)) < 0.02
    weighted = np.mean([sum(p[tuple(x["ids"].tolist())] / x["inclusion"] for x in r) for r in rows])
    assert abs(weighted - 1) < 0.02  # the inclusion probabilities make unbiased weights
