"""Scalar functions: normalisation, ratios, guarded arithmetic, labels and hashes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .. import config

# Formats of labels (fixed values).
CONTROL_LABEL = "Non-Targeting"
CONTROL_PREFIX = "non-targeting"
GUIDE_TARGET = r"^(.+?)_(?:P\d|ENST\d)"
PROMOTER_MARK = r"_(P1P2|P1|P2)(?![0-9P])"
BATCH_PREFIX = "Flex_"
CLONE_SUFFIX = r" \(clone.*\)$"
MITOCHONDRIAL_PREFIX = "MT-"
TECHNICAL_GENE = "^(MT-|RPL|RPS)"
KINASE_GENE = "^RPS6K"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cpm(count: Column | str, total: Column | str) -> Column:
    """Counts per million.  Dividing by total / 1e6 keeps equal counts of equal rows equal to the last bit."""
    return safe_divide(_c(count).cast("double"), _c(total).cast("double") / config.CPM_SCALE)


def cpm_within(count: Column | str, *keys: str) -> Column:
    return cpm(count, F.sum(_c(count)).over(Window.partitionBy(*keys)))


def log1p_cp10k(count: Column | str, total: Column | str) -> Column:
    return F.log1p(safe_divide(_c(count).cast("double") * 1e4, _c(total)))


def log_pseudobulk(count: Column | str, total: Column | str, scale: float = config.PROFILE_SCALE) -> Column:
    return F.log1p(safe_divide(_c(count).cast("double") * scale, _c(total)))


def log_profile(cpm_value: Column | str, pseudocount: float = config.TRANSFER_PSEUDOCOUNT) -> Column:
    return F.log1p(_c(cpm_value) / pseudocount)


def log2_ratio(a: Column | str, b: Column | str, epsilon: float = config.LFC_EPSILON) -> Column:
    return F.log2((_c(a) + epsilon) / (_c(b) + epsilon))


def safe_divide(a: Column | str, b: Column | str, otherwise: float | None = None) -> Column:
    """a / b; null, or ``otherwise``, where b is 0."""
    ratio = F.try_divide(_c(a), _c(b))
    return ratio if otherwise is None else F.coalesce(ratio, F.lit(otherwise))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    x = _c(x)
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def pearson_residual(y: Column | str, mu: Column | str, theta: Column | str | float, limit: float | None = None) -> Column:
    """(y - mu) / sqrt(mu + mu^2 / theta), clipped to +-limit."""
    mu, theta = _c(mu), F.lit(theta) if isinstance(theta, (int, float)) else _c(theta)
    residual = safe_divide(_c(y) - mu, F.sqrt(mu + mu * mu / theta))
    return residual if limit is None else clip(residual, -limit, limit)


def sign_agrees(a: Column | str, b: Column | str) -> Column:
    return F.signum(_c(a)) == F.signum(_c(b))


def softplus_inverse(x: Column | str) -> Column:
    return F.log(F.expm1(_c(x)))


def normalize_symbol(s: Column | str) -> Column:
    return F.upper(F.trim(_c(s)))


def lenient_bool(s: Column | str) -> Column:
    """1, true and yes in any case are true; anything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(_c(s))).isin("1", "true", "yes"), F.lit(False))


def nullable_int(s: Column | str) -> Column:
    """Integer of a text; null for an empty one or one that is no integer."""
    return F.nullif(F.trim(_c(s)), F.lit("")).try_cast("long")


def guide_target(guide: Column | str, control: str = CONTROL_LABEL) -> Column:
    """Target of a guide label: of the first |-part what precedes _P<digit> or _ENST<digit>.

    Labels that begin with non-targeting are controls; other labels without the pattern give null.
    """
    guide = _c(guide)
    first = F.split(guide, r"\|")[0]
    found = F.regexp_extract(first, GUIDE_TARGET, 1)
    return F.when(F.lower(guide).startswith(CONTROL_PREFIX), F.lit(control)).otherwise(F.nullif(found, F.lit("")))


def promoter_class(guide: Column | str) -> Column:
    """Distinct P1P2, P1, P2 marks of a label, sorted and joined by +; null without any."""
    marks = F.regexp_extract_all(_c(guide), F.lit(PROMOTER_MARK), F.lit(1))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(marks)), "+"), F.lit(""))


def population_part(label: Column | str, part: int = 1, parts: int = 4, sep: str = "_") -> Column:
    """One of exactly ``parts`` parts of a label; null for labels with another number of parts."""
    split = F.split(_c(label), sep)
    return F.when(F.size(split) == parts, split[part])


def batch_number(label: Column | str, prefix: str = BATCH_PREFIX) -> Column:
    return F.nullif(F.regexp_extract(_c(label), prefix + r"(\d)", 1), F.lit("")).cast("int")


def strip_suffix(label: Column | str, pattern: str = CLONE_SUFFIX) -> Column:
    return F.regexp_replace(_c(label), pattern, "")


def canonical_json(*columns: str) -> Column:
    """Compact JSON array of texts: the identity of a row."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def sha_bucket(identity: Column | str, buckets: int = 4) -> Column:
    """First 8 bytes of SHA-256 as an unsigned big-endian number, mod ``buckets`` (a power of two up to 16)."""
    if buckets not in (1, 2, 4, 8, 16):
        raise ValueError("buckets: a power of two up to 16")
    digit = F.conv(F.substring(F.sha2(_c(identity).cast("string").cast("binary"), 256), 16, 1), 16, 10).cast("int")
    return digit % buckets


def sha_bit(identity: Column | str) -> Column:
    """Lowest bit of the first byte of SHA-256."""
    return F.conv(F.substring(F.sha2(_c(identity).cast("string").cast("binary"), 256), 2, 1), 16, 10).cast("int") % 2


def crc_seed(*parts: Column) -> Column:
    """CRC32 of the parts joined by colons."""
    return F.crc32(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def hash_order(*parts: Column | str, seed: int = 0) -> Column:
    """Text whose order is a random order of the parts, the same in every run and engine."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]).cast("binary"), 256)


def hash_uniform(*parts: Column | str, seed: int = 0) -> Column:
    """Number in (0, 1) from the first 12 hexadecimal digits of ``hash_order``."""
    return (F.conv(F.substring(hash_order(*parts, seed=seed), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def array_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_cosine(a: Column | str, b: Column | str, zero_norm: float | None = None) -> Column:
    return safe_divide(array_dot(a, b), F.sqrt(array_dot(a, a) * array_dot(b, b)), zero_norm)


def evidence_tier(n: Column | str) -> Column:
    out = F.lit(config.TOP_TIER)
    for bound, name in reversed(config.EVIDENCE_TIERS):
        out = F.when(_c(n) < bound, name).otherwise(out)
    return out


def is_technical(symbol: Column | str) -> Column:
    """Mitochondrial and ribosomal protein genes; kinases RPS6K are none."""
    return _c(symbol).rlike(TECHNICAL_GENE) & ~_c(symbol).rlike(KINASE_GENE)


def interval_gap(chr_a, start_a, end_a, chr_b, start_b, end_b) -> Column:
    """0 for overlapping intervals, the gap between others, null on different chromosomes."""
    gap = F.greatest(F.lit(0), _c(start_b) - _c(end_a), _c(start_a) - _c(end_b))
    return F.when(_c(chr_a) == _c(chr_b), gap)


#: Coefficients, from the highest power down, of a published rational fit of the complementary error function whose relative error
#: is below 1.2e-7 everywhere (fixed values).
ERFC_FIT = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def normal_two_sided(z: Column | str) -> Column:
    """P(|N| >= |z|) of a standard normal, as a column expression."""
    x = F.abs(_c(z)) / 1.4142135623730951
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(ERFC_FIT[0])
    for c in ERFC_FIT[1:]:
        fit = c + t * fit
    return t * F.exp(-x * x + fit)
