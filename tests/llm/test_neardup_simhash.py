"""Near-dedup's SimHash step: its classes decide which texts meet, the exact similarity which of them are alike."""

import numpy as np
import pyarrow as pa

from quarryflow.llm import neardup

from .test_neardup import kept
from .test_queries import classes

#: Each and its first twelve words: 8 of 10 shingles in common, fingerprints within 2 bits, and no min-hash band equal.
BEYOND_BANDS = [
    "opob yebv ncpv dpee bxyd sktd yscm fhvu ivbr lpvd knuz yygb lfdb ahms",
    "hbkp dyvs livm gawv dyyf mhjv puqp shzu hqir omdz irhh lvwv tgpr fcez",
    "fsyp rkry powl kvdu qssl fcgr ceai xulp ijdb mani bjtc npjy zkgi bbnm",
    "mgrz bpxw vljg xsjt egzm zdjp rbyw uicx afeu ydjf vlmb bdep dfmd okdl",
]


def signed(texts):
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([b""] * n), pa.array(texts)], ["row", "id", "key", "text"])
    return pa.Table.from_batches(list(neardup._signatures(iter([batch]), 5))).to_pydict()


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_simhash_links_what_no_band_does(spark):
    rows = []
    for k, text in enumerate(BEYOND_BANDS):
        short = " ".join(text.split()[:12])
        found = signed([short, text])
        assert apart(*found["fp"]) <= 2 and not set(found["bands"][0]) & set(found["bands"][1])
        rows += [(2 * k, short), (2 * k + 1, text)]
    assert kept(spark, rows) == [0, 2, 4, 6]


def test_simhash_alone_does_not_make_texts_alike(spark):
    dice = np.random.default_rng(1)
    texts = [" ".join(bytes(w).decode() for w in t) for t in dice.integers(97, 123, (40_000, 8, 4), np.uint8)]
    fp, short = signed(texts)["fp"], signed([t[:34] for t in texts])["fp"]  # 4 shingles, and 3 of them
    linked = [k for k in range(len(texts)) if apart(fp[k], short[k]) <= 2][:5]
    assert linked
    rows = [x for n, k in enumerate(linked) for x in ((2 * n, texts[k]), (2 * n + 1, texts[k][:34]))]
    assert len(kept(spark, rows)) == len(rows)


def test_classes_are_brute_force(spark):
    dice = np.random.default_rng(2)
    fp = dice.integers(-(1 << 63), 1 << 63, 60).tolist()
    fp += [x ^ 1 << int(a) ^ 1 << int(b) for x in fp[:40] for a, b in dice.integers(0, 63, (2, 2))] + [0, 0, 5]
    got = neardup.classes(spark.createDataFrame([(k, x, 9) for k, x in enumerate(fp)], "id long, fp long, size long")).collect()
    root = classes(len(fp), [(a, b) for b in range(len(fp)) for a in range(b) if apart(fp[a], fp[b]) <= 2])
    bands = {r["id"]: r["band"] for r in got}
    assert len(bands) == len(got) == len(fp)
    assert len({(bands[k], root[k]) for k in bands}) == len(set(bands.values())) == len({root[k] for k in bands}) < len(fp)
