"""Column expressions for thermodynamic and geometric quantities. All run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AMU_A3_TO_G_CM3, BAR_A3_TO_EV, EV_A3_TO_GPA, KB, KB_SCATTERING, TIME_UNIT_FS


def pv(pressure: Column, volume: Column) -> Column:
    """P·V in eV, from bar and Å³."""
    return pressure * volume * F.lit(BAR_A3_TO_EV)


def enthalpy(pe: Column, ke: Column, pressure: Column, volume: Column) -> Column:
    return pe + ke + pv(pressure, volume)


def density(mass_amu: Column, volume: Column) -> Column:
    """g/cm³; null unless the volume is positive."""
    return F.when(volume > 0, mass_amu * F.lit(AMU_A3_TO_G_CM3) / volume)


def min_image(delta: Column, length: Column) -> Column:
    """Nearest periodic image; halves round to even."""
    return delta - F.rint(delta / length) * length


def wrap(u: Column, lo: Column, length: Column) -> Column:
    return lo + F.pmod(u - lo, length)


def unwrap(x: Column, image: Column, length: Column) -> Column:
    return x + image * length


def to_cartesian(s: Column, lo: Column, length: Column) -> Column:
    return lo + s * length


def to_scaled(x: Column, length: Column) -> Column:
    return x / length


def mixing_entropy_term(x: Column, temperature: Column) -> Column:
    """k_B·T·(x ln x + (1-x) ln(1-x)), 0 at and beyond the endpoints."""
    inner = (x > 0) & (x < 1)
    return F.when(inner, F.lit(KB) * temperature * (x * F.ln(x) + (1 - x) * F.ln(1 - x))).otherwise(F.when(x.isNotNull(), F.lit(0.0)))


def free_energy(h: Column, temperature: Column, entropy: Column) -> Column:
    return h - temperature * entropy


def normalized(raw: Column, n_atoms: Column, x_b: Column, e_b: Column, e_fe: Column) -> Column:
    """Energy per atom above the mixture of the endpoints."""
    return raw / n_atoms - (1 - x_b) * e_fe - x_b * e_b


def normalized_error(raw: Column, n_atoms: Column, x_b: Column, e_b: Column, e_fe: Column) -> Column:
    parts = [raw / n_atoms, (1 - x_b) * e_fe, x_b * e_b]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def timestep_fs(value: Column, units: Column) -> Column:
    """Femtoseconds of a time step; an unknown unit system is an error."""
    out = F.raise_error(F.concat(F.lit("unknown units: "), F.coalesce(units, F.lit("null"))))
    for name, factor in TIME_UNIT_FS.items():
        out = F.when(F.lower(units) == name, value * F.lit(factor)).otherwise(out)
    return out


def concentration_structure(s_ff: Column, s_fb: Column, s_bb: Column, x_fe: Column, rho: Column) -> Column:
    """Bhatia–Thornton S_cc from the partial structure factors."""
    x_b = 1 - x_fe
    return (x_b * x_b * s_ff - 2 * x_b * x_fe * s_fb + x_fe * x_fe * s_bb) / rho


def thermodynamic_factor(x_fe: Column, scc0: Column) -> Column:
    return F.when(scc0 != 0, x_fe * (1 - x_fe) / scc0)


def gibbs_curvature(scc0: Column, temperature: Column) -> Column:
    return F.when(scc0 != 0, F.lit(KB_SCATTERING) * temperature / scc0)


def excess_curvature(gamma: Column, x_b: Column) -> Column:
    mixed = x_b * (1 - x_b)
    return F.when(mixed != 0, (gamma - 1) / mixed)


def pressure_gpa(stress: Column) -> Column:
    """Minus the mean of the first three stress components (eV/Å³)."""
    return -(F.get(stress, 0) + F.get(stress, 1) + F.get(stress, 2)) / 3 * F.lit(EV_A3_TO_GPA)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(formula: Column) -> Column:
    """Elements in order, as ``(s, n)``; a missing number is 1."""

    def token(t: Column) -> Column:
        symbol = F.regexp_replace(t, "[0-9]+", "")
        digits = F.substring(t, F.length(symbol) + 1, F.length(t))
        return F.struct(symbol.alias("s"), F.when(digits == "", F.lit(1).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))).alias("n"))

    return F.transform(F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?[0-9]*"), 0), token)


def _total(tokens: Column, wanted=None) -> Column:
    add = lambda a, t: a + (t["n"] if wanted is None else F.when(t["s"] == wanted, t["n"]).otherwise(0))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), add)


def element_counts(formula: Column) -> Column:
    """Map element → count; a missing number is 1 and repeats add up."""
    keys = lambda tokens: F.array_distinct(F.transform(tokens, lambda t: t["s"]))
    return _let(_tokens(formula), lambda tokens: F.map_from_arrays(keys(tokens), F.transform(keys(tokens), lambda k: _total(tokens, k))))


def mole_fraction(formula: Column, element: str) -> Column:
    share = lambda tokens: F.when(_total(tokens) > 0, _total(tokens, F.lit(element)) / _total(tokens))
    return _let(_tokens(formula), share)


def subscript_label(formula: Column) -> Column:
    """Formula with its numbers as subscripts in braces."""
    return F.regexp_replace(formula, "([0-9]+)", "_{$1}")


def type_label_map(text: Column) -> Column:
    """``1:Na,2:O`` (or ``=``) to a map of strings."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*[:=]\s*", ":"), r"\s*,\s*", ",")
    return F.map_filter(F.str_to_map(tidy, F.lit(","), F.lit(":")), lambda k, _: k != "")


def axis_map(x: Column, n: Column, lo: float = 0.70, span: float = 0.20) -> Column:
    return (x - lo) * (n - 1) / span


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def horner(coefficients: Column, x: Column) -> Column:
    """Polynomial value, highest power first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda acc, c: acc * x + c)


def derivative(coefficients: Column) -> Column:
    n = F.size(coefficients)
    return F.slice(F.transform(coefficients, lambda c, i: c * (n - 1 - i)), F.lit(1), F.greatest(n - 1, F.lit(0)))


def signed_curvature(coefficients: Column, x: Column) -> Column:
    """y″/(1+y′²)^1.5 of a polynomial."""
    one, two = derivative(coefficients), derivative(derivative(coefficients))
    return horner(two, x) / F.pow(1 + F.pow(horner(one, x), 2), 1.5)


def window_weight(r: Column, cutoff: Column) -> Column:
    """1 - 1.5x + 0.5x³ with x = r/cutoff clipped to [0, 1]."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r / cutoff))
    return 1 - 1.5 * x + 0.5 * x * x * x


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / F.when(x != 0, x))


def number_or_na(x: Column, fmt: str = "%.6f") -> Column:
    return F.when(finite(x), F.format_string(fmt, x)).otherwise(F.lit("N/A"))
