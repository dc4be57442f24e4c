"""Processor and graphics labels and scores as first-match rule chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank import rules
from shelfrank.functions.text import (
    col, contains_any, first_keyword, first_match, group, lookup, matches, prefix_lookup, to_long,
)


def cpu_score(cpu: Column | str) -> Column:
    """0-10; a known model is moved by its power suffix, a bare family is not."""
    text = F.lower(col(cpu))
    shift = first_match(
        [
            (text.contains("hx"), F.lit(0.5)),
            (contains_any(text, [" u", "-u"]), F.lit(-1.0)),
            (contains_any(text, [" p", "-p"]), F.lit(-0.3)),
        ],
        F.lit(0.0),
    )
    model = first_keyword(text, rules.CPU_SCORES)
    return F.coalesce(
        F.when(model.isNotNull(), F.least(F.lit(10.0), model + shift)),
        first_keyword(text, rules.CPU_FAMILY_SCORES),
        F.lit(rules.CPU_SCORE_DEFAULT),
    )


def gpu_label(gpu: Column | str) -> Column:
    """Readable graphics label, one per model."""
    text = F.lower(col(gpu))
    packed = F.replace(text, F.lit(" "), F.lit(""))
    # Label patterns.
    rtx = r"\brtx[\s\-]?(\d{3,4})(?:\s*(ti|super|max\-q|laptop)?)?\b"
    gtx = r"\bgtx[\s\-]?(\d{3,4})(?:\s*(ti|super))?\b"
    mx = r"\bmx[\s\-]?(\d{2,3})\b"
    rx_ = r"\brx[\s\-]?(\d{3,4})(?:\s*([ms]|xt|xtx))?\b"
    arc = r"\barc[\s\-]?([a-z]?\d{3,4}m?)\b"
    return F.coalesce(
        F.when(text.isNull() | matches(text, r"^\s*$"), F.lit("Integrated (generic)")),
        F.concat(F.lit("GeForce RTX "), group(text, rtx)),
        F.concat(
            F.lit("GeForce GTX "), group(text, gtx),
            F.coalesce(F.concat(F.lit(" "), F.upper(group(text, gtx, 2))), F.lit("")),
        ),
        F.concat(F.lit("NVIDIA MX "), group(text, mx)),
        F.concat(F.lit("Radeon RX "), group(packed, rx_), F.coalesce(F.upper(group(packed, rx_, 2)), F.lit(""))),
        F.concat(F.lit("Intel Arc "), F.upper(group(text, arc))),
        F.concat(F.lit("Apple M"), group(text, r"\bm([1-4])\b"), F.lit(" GPU")),
        F.when(text.contains("iris xe"), F.lit("Intel Iris Xe (iGPU)")),
        F.when(text.contains("iris plus"), F.lit("Intel Iris Plus (iGPU)")),
        F.when(
            contains_any(text, ["uhd graphics", "hd graphics"]) | matches(text, r"\buhd\b"),
            F.lit("Intel UHD (iGPU)"),
        ),
        F.concat(F.lit("Radeon "), group(text, r"radeon\s*(\d{3})m\b"), F.lit("M (iGPU)")),
        F.concat(F.lit("Radeon Vega "), group(text, r"\bvega\s*(8|7|6|3)\b"), F.lit(" (iGPU)")),
        F.when(contains_any(text, ["integrated", "igpu", "apu graphics"]), F.lit("Integrated (generic)")),
        F.when(contains_any(text, ["geforce", "nvidia", "radeon"]), F.lit("Discrete GPU (Unknown)")),
        F.lit("GPU (Unlabeled)"),
    )


def gpu_score(gpu: Column | str) -> Column:
    """0-10 from a label or from raw text."""
    text = F.lower(col(gpu))
    arc = F.upper(group(text, r"\barc\s*([a-z]?\d{3,4}m?)\b"))
    rtx = F.coalesce(group(text, r"rtx\s*([345]\d{3,4})"), group(text, r"rtx(\d{4})"))
    gtx = group(text, r"gtx\s*(\d{3,4})")
    mx = F.coalesce(group(text, r"\bmx\s*(\d{2,3})\b"), group(text, r"mx(\d{2,3})"))
    rx_ = F.upper(group(F.replace(text, F.lit(" "), F.lit("")), r"\brx\s*(\d{3,4}m?)\b"))
    rx_base = F.replace(rx_, F.lit("M"), F.lit(""))
    return first_match(
        [
            (text.isNull(), F.lit(2.0)),
            (
                contains_any(text, rules.IGPU_KEYWORDS),
                first_match(
                    [
                        (contains_any(text, ["780m", "680m"]), F.lit(3.5)),
                        (contains_any(text, ["760m", "660m"]), F.lit(3.0)),
                    ],
                    F.lit(2.5),
                ),
            ),
            (arc.isNotNull(), first_keyword(arc, rules.ARC_SCORES, F.lit(3.0))),
            (
                rtx.isNotNull(),
                F.coalesce(lookup(rtx, rules.RTX_SCORES), prefix_lookup(rtx, rules.RTX_SERIES_SCORES), F.lit(6.5)),
            ),
            (gtx.isNotNull(), lookup(gtx, rules.GTX_SCORES, F.lit(4.5))),
            (mx.isNotNull(), lookup(mx, rules.MX_SCORES, F.lit(3.5))),
            (
                rx_.isNotNull(),
                F.coalesce(
                    lookup(rx_, rules.RX_SCORES), lookup(rx_base, rules.RX_SCORES),
                    prefix_lookup(rx_base, rules.RX_SERIES_SCORES), F.lit(5.5),
                ),
            ),
            *[(matches(text, rf"\b{m}\b"), F.lit(s)) for m, s in rules.APPLE_GPU_SCORES.items()],
            (contains_any(text, ["geforce", "nvidia", "radeon", "discrete"]), F.lit(4.0)),
        ],
        F.lit(2.0),
    )


def cpu_suffix(cpu: Column | str) -> Column:
    """Power class of the processor text: hx, h, p, u or empty."""
    text = F.lower(F.coalesce(col(cpu), F.lit("")))
    return first_match(
        [
            (text.contains("hx"), F.lit("hx")),
            (matches(text, r"(?<!h)h(?!x)"), F.lit("h")),
            (contains_any(text, ["-p", " p"]), F.lit("p")),
            (contains_any(text, ["-u", " u"]), F.lit("u")),
            (text.contains("ultra") & matches(text, r"\b2\d{2}v\b"), F.lit("p")),
        ],
        F.lit(""),
    )


def has_dgpu(label: Column | str) -> Column:
    return ~contains_any(F.lower(F.coalesce(col(label), F.lit(""))), rules.NOT_DISCRETE)


def has_cuda(label: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(col(label), F.lit(""))), ["rtx", "geforce"])


def rtx_tier(label: Column | str) -> Column:
    text = F.lower(F.coalesce(col(label), F.lit("")))
    return F.coalesce(to_long(group(text, r"rtx\s*(\d{4})")), F.lit(0).cast("bigint")).cast("int")
