"""Fill-in-the-middle: texts cut at two unit borders and put together again in another order, for training on infilling.

A unit is a run of non-spaces with the spaces before it, or spaces at the end of the text. Its borders are found without going through
the bytes one by one: the UTF-8 bytes of a batch are viewed as 64-bit words, eight lanes each. Additions that cannot carry from lane to
lane compare all eight with the space characters at once and leave the answer in the lanes' top bits; a lane that is no space and whose
next lane is one ends a unit. `bitwise_count` gives the ends of each word and a running sum those of all words before, so the k-th end
is found by a binary search for its word and a multiplication that counts the ends up to each lane inside it.

    plain  text as it is
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Draws come from the sha-256 of "seed:doc_id", so a document is cut alike in every run. Each text takes about four times its own bytes
of memory, whatever its length; no row is shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import documents, text_chunks

SEED = 42
RATE = 50                          # per cent of the texts that are rearranged
SPM = 80                           # per cent of these in the form spm
MARKERS = (b"<P>", b"<S>", b"<M>")

_ONES = np.uint64(0x0101010101010101)
_TOP = np.uint64(0x8080808080808080)


def _lanes(x: int) -> np.uint64:
    return np.uint64(x) * _ONES


def unit_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words of eight bytes each; the top bit of a lane is set where a unit of a text ends. One empty word follows the last."""
    n = len(data)
    padded = np.full((n // 8 + 1) * 8 + 8, 0x20, np.uint8)
    padded[:n] = data
    x = padded.view("<u8")
    low = x & _lanes(0x7F)
    space = ((low + _lanes(0x80 - 0x09)) & ~(low + _lanes(0x80 - 0x0E))) | ((low + _lanes(0x80 - 0x20)) & ~(low + _lanes(0x80 - 0x21)))
    space &= ~x & _TOP
    following = space >> np.uint64(8)
    following[:-1] |= space[1:] << np.uint64(56)
    ends = ~space & _TOP & following
    last = offs[1:][np.diff(offs) > 0] - 1
    ends.view(np.uint8)[last] = 0x80                                       # a text's last byte ends a unit, also at a word of the next text
    return ends


class UnitEnds:
    """Counting and finding unit ends in the words of `unit_ends`."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.ends = unit_ends(data, offs)
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def before(self, place: np.ndarray) -> np.ndarray:
        """Ends below each byte place."""
        word, lane = place >> 3, (place & 7).astype(np.uint64)
        own = self.ends[word]
        below = (np.uint64(1) << (lane * np.uint64(8))) - np.uint64(1)
        return self.upto[word] - np.bitwise_count(own) + np.bitwise_count(own & below)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th end, counted from 1."""
        word = np.searchsorted(self.upto, k)
        own = self.ends[word]
        inside = (k - (self.upto[word] - np.bitwise_count(own))).astype(np.uint64)
        counted = (own >> np.uint64(7)) * _ONES                            # in each lane: ends in it and in the lanes below
        reached = ((counted | _TOP) - inside * _ONES) & _TOP
        return word * 8 + (8 - np.bitwise_count(reached).astype(np.int64)) + 1


def _characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _rearranged(rate: int, spm: int):
    def run(batches):
        for b in batches:
            draws = np.stack([np.asarray(b.column(f"h{i}"), np.int64) for i in range(1, 5)])
            for first, end, data, offs in text_chunks(b.column("text")):
                units = UnitEnds(data, offs)
                begin = units.before(offs[:-1])
                n = units.before(offs[1:]) - begin
                h = draws[:, first:end]
                cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
                places = [np.where(c > 0, units.after(begin + c), offs[:-1]) for c in cuts]
                drawn = h[2] % 100 < rate
                order = h[3] % 100 < spm
                out, forms, prefixes, middles = [], [], [], []
                raw = data.tobytes()
                for i in range(end - first):
                    s, e, x, y = int(offs[i]), int(offs[i + 1]), int(places[0][i]), int(places[1][i])
                    text = raw[s:e]
                    if s == e or not drawn[i] or any(m in text for m in MARKERS):
                        out.append(text)
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        continue
                    prefix, middle, suffix = raw[s:x], raw[x:y], raw[y:e]
                    forms.append("spm" if order[i] else "psm")
                    parts = (MARKERS[1], suffix, MARKERS[0], prefix) if order[i] else (MARKERS[0], prefix, MARKERS[1], suffix)
                    out.append(b"".join((*parts, MARKERS[2], middle)))
                    prefixes.append(_characters(prefix))
                    middles.append(_characters(middle))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(first, end - first), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each row of `docs` (doc_id, text; other columns do not matter).

    A null text is empty. Empty texts, texts that hold a marker, and those not drawn are plain: output is the text, the counts of
    characters are null. A null doc_id draws from "seed:null". Repeated rows come out alike, an empty table gives an empty one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return docs.select("doc_id", "text", *draws).mapInArrow(_rearranged(rate, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A rearranged text holds no marker of its own, so its three are the only ones."""
    part = F.split(output, "<[PSM]>", -1)
    whole = lambda first, second: F.concat(F.get(part, F.lit(first)), F.get(part, F.lit(3)), F.get(part, F.lit(second)))
    return F.when(form == "psm", whole(1, 2)).when(form == "spm", whole(2, 1)).otherwise(output)


def op13_fill_middle(spark, sf_dir):
    done = fill_in_middle(documents(spark, sf_dir))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
      list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM t),
c AS (SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
      WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
