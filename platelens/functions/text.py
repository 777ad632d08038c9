"""Text expressions: whitespace handling, item-name cleaning, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAME_SYMBOLS, WS_CHARS, WS_CLASS

_WS_RUN = WS_CLASS + "+"
_TO_SPACE = " " * len(WS_CHARS)
# Step 2: a final quote not preceded by a decimal digit of any script (an
# inch mark such as 6" stays).
_TRAILING_QUOTE = r'(?<!\p{Nd})"\z'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (all 29 characters of
    WS_CHARS, not only U+0020 as plain ``F.trim`` does). Native trim, no
    regex."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def _spaces_collapsed(t: Column) -> Column:
    # t holds no whitespace but U+0020; most names have no double space.
    return F.trim(F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))


def clean_item_name(c) -> Column:
    """Clean a raw item name; null stays null.

    Steps, in this (observable) order:
      1. a leading ``"`` is removed (one only), then the rest is stripped;
      2. a trailing ``"`` is removed (one only) unless a digit precedes it
         (``6"`` is an inch mark), then stripped;
      3. the symbols ``®``, ``*`` and ``,`` are removed, then stripped;
      4. whitespace runs become one space, then stripped.

    Steps 1-2 can only change a name that holds a quote, so other names skip
    them. Step 1 is native (prefix test, substring, trim); step 2 removes one
    final quote with a tiny anchored regex and trims. That trim also runs
    when no quote was removed, which cannot change the result: steps 3-4
    end with a trim, and trimming earlier never changes what they return.
    Steps 3-4 are one ``translate`` (whitespace -> space, symbols deleted)
    and a space collapse. The input is referenced five times, so the
    expression stays small even if the optimizer substitutes a computed
    column for it.
    """
    s = _c(c)
    q1 = F.when(s.startswith('"'), strip_ws(F.substring(s, 2, 1 << 30))).otherwise(s)
    q2 = strip_ws(F.regexp_replace(q1, _TRAILING_QUOTE, ""))
    s = F.when(s.contains('"'), q2).otherwise(s)
    return _spaces_collapsed(F.translate(s, WS_CHARS + NAME_SYMBOLS, _TO_SPACE))


def split_words(c) -> Column:
    """Split on whitespace runs; no empty words (``''`` -> empty array)."""
    t = F.trim(F.translate(_c(c), WS_CHARS, _TO_SPACE))
    return F.filter(F.split(t, " +"), lambda w: w != "")


def number_text(c) -> Column:
    """Render a double as text: whole values without a fraction (1210.0 ->
    '1210', 1e20 -> '100000000000000000000'), others in plain decimals (900.1 ->
    '900.1', 0.0005 -> '0.0005'), without an exponent up to 18 decimals. NaN and
    infinities keep their names."""
    x = _c(c)
    text = x.cast("string")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = F.rtrim(F.rtrim(x.try_cast("decimal(38,18)").cast("string"), F.lit("0")), F.lit("."))
    # from 9e18 on every double is whole; a decimal has the digits that its text has
    whole = F.coalesce(x.try_cast("decimal(38,0)").cast("string"), F.format_string("%.0f", x))
    return (F.when((x == F.floor(x)) & (F.abs(x) < 9e18), x.cast("bigint").cast("string"))
            .when(finite & (F.abs(x) >= 9e18), whole)
            .when(text.contains("E") & (F.abs(x) >= 1e-18), F.coalesce(plain, text))
            .otherwise(text))


def label(*parts) -> Column:
    """Concatenate label parts; null if any part is null (``F.concat``
    semantics, unlike ``concat_ws`` which skips nulls). Plain strings are
    literals, Columns are used as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
