"""Functions of a page description: interpolation, stitching, calculators, colour, blending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def exponential(x: Column, c0: float, c1: float, n: float, domain: tuple[float, float] = (0, 1), bounds: tuple[float, float] | None = None) -> Column:
    y = F.lit(float(c0)) + F.pow(clamp(x, *domain), F.lit(float(n))) * float(c1 - c0)
    return clamp(y, *bounds) if bounds else y


def stitched(x: Column, parts: list, bounds: list[float], encode: list[tuple[float, float]], domain: tuple[float, float] = (0, 1)) -> Column:
    """Piecewise: each part is a function of a Column, its piece mapped to its encoding."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    pieces = []
    for f, lo, hi, (a, b) in zip(parts, edges, edges[1:], encode):
        pieces.append(f(F.lit(float(a)) + (x - float(lo)) * (float(b - a) / float(hi - lo)) if hi > lo else F.lit(float(a))))
    return reduce(lambda rest, p: F.when(x < float(p[0]), p[1]).otherwise(rest), list(zip(bounds, pieces))[::-1], pieces[-1])


def sampled(x: Column, table: list[float], domain: tuple[float, float] = (0, 1)) -> Column:
    """Linear between the entries of a table over the domain."""
    at = (clamp(x, *domain) - float(domain[0])) * ((len(table) - 1) / float(domain[1] - domain[0]))
    values = F.array(*[F.lit(float(v)) for v in table])
    low = F.least(F.floor(at), F.lit(len(table) - 2)).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, low + 2)
    return a + (b - a) * (at - low)


_UNARY = {
    "abs": F.abs, "neg": lambda x: -x, "ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"),
    "truncate": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "sqrt": F.sqrt, "sin": lambda x: F.sin(F.radians(x)), "cos": lambda x: F.cos(F.radians(x)),
    "ln": F.ln, "log": F.log10, "cvr": lambda x: x.cast("double"), "cvi": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "mod": lambda a, b: a % b, "exp": F.pow,
    "idiv": lambda a, b: _UNARY["truncate"](a / b), "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b,
}


def calculator(program: str, *inputs: Column, limit: int = 100) -> list[Column]:
    """Compile a stack program ("x y add { a } { b } ifelse") to Columns, one per value left."""
    words = program.replace("{", " { ").replace("}", " } ").split()

    def block(i: int) -> tuple[list, int]:
        out: list = []
        while i < len(words) and words[i] != "}":
            if words[i] == "{":
                inner, i = block(i + 1)
                out.append(inner)
            else:
                out.append(words[i])
            i += 1
        return out, i

    def run(code: list, stack: list[Column]) -> list[Column]:
        held: list = []
        for w in code:
            if isinstance(w, list):
                held.append(w)
                continue
            if len(stack) > limit:
                raise ValueError("stack limit")
            if w in _UNARY:
                stack.append(_UNARY[w](stack.pop()))
            elif w in _BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(_BINARY[w](a, b))
            elif w == "not":
                stack.append(~stack.pop())
            elif w == "dup":
                stack.append(stack[-1])
            elif w == "pop":
                stack.pop()
            elif w == "exch":
                stack[-2:] = stack[:-3:-1]
            elif w in ("true", "false"):
                stack.append(F.lit(w == "true"))
            elif w in ("copy", "index", "roll"):
                raise ValueError(f"{w} needs a literal count: write {w}:N")
            elif ":" in w:
                name, *args = w.split(":")
                n = int(args[0])
                if name == "copy":
                    stack += stack[-n:] if n else []
                elif name == "index":
                    stack.append(stack[-1 - n])
                else:
                    j = int(args[1]) % n
                    stack[-n:] = stack[len(stack) - j :] + stack[-n : len(stack) - j]
            elif w == "if":
                test, then = stack.pop(), run(held.pop(), list(stack))
                stack = [F.when(test, t).otherwise(s) for s, t in zip(stack, then, strict=True)]
            elif w == "ifelse":
                test, other, then = stack.pop(), held.pop(), held.pop()
                stack = [F.when(test, t).otherwise(e) for t, e in zip(run(then, list(stack)), run(other, list(stack)), strict=True)]
            else:
                stack.append(F.lit(float(w)))
        return stack

    return run(block(0)[0], list(inputs))


# ------------------------------------------------------------------------ colour

#: D50 white point (fixed values).
WHITE = (0.9642, 1.0, 0.8249)


def lab_to_xyz(l: Column, a: Column, b: Column, white: tuple[float, float, float] = WHITE) -> list[Column]:  # noqa: E741
    m = (l + 16.0) / 116.0
    g = lambda t: F.when(t >= 6.0 / 29.0, t * t * t).otherwise((t - 4.0 / 29.0) * (108.0 / 841.0))
    return [g(m + a / 500.0) * white[0], g(m) * white[1], g(m - b / 200.0) * white[2]]


def xyz_to_lab(x: Column, y: Column, z: Column, white: tuple[float, float, float] = WHITE) -> list[Column]:
    f = lambda t: F.when(t > (6.0 / 29.0) ** 3, F.cbrt(t)).otherwise(t * (841.0 / 108.0) + 4.0 / 29.0)
    fx, fy, fz = f(x / white[0]), f(y / white[1]), f(z / white[2])
    return [fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0]


def linear_to_srgb(x: Column) -> Column:
    x = clamp(x, 0, 1)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


MODES = ("Normal", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion")


def blend(mode: str, b: Column, s: Column) -> Column:
    """Separable blend of backdrop and source, both in 0..1."""
    one = F.lit(1.0)
    hard = lambda b, s: F.when(s <= 0.5, b * s * 2.0).otherwise(b + (s * 2.0 - 1.0) - b * (s * 2.0 - 1.0))
    d = F.when(b <= 0.25, ((b * 16.0 - 12.0) * b + 4.0) * b).otherwise(F.sqrt(b))
    return {
        "Normal": s, "Multiply": b * s, "Screen": b + s - b * s, "Overlay": hard(s, b), "Darken": F.least(b, s), "Lighten": F.greatest(b, s),
        "ColorDodge": F.when(b == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(one, b / F.greatest(one - s, F.lit(1e-12)))),
        "ColorBurn": F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(one - F.least(one, (one - b) / F.greatest(s, F.lit(1e-12)))),
        "HardLight": hard(b, s), "SoftLight": F.when(s <= 0.5, b - (one - s * 2.0) * b * (one - b)).otherwise(b + (s * 2.0 - 1.0) * (d - b)),
        "Difference": F.abs(b - s), "Exclusion": b + s - b * s * 2.0,
    }[mode]


def luminosity(r: Column, g: Column, b: Column) -> Column:
    return r * 0.3 + g * 0.59 + b * 0.11


def finite_median(x: Column) -> Column:
    """Aggregate: median of the finite values, the middle pair averaged."""
    return F.percentile(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x), F.lit(0.5))


def _clip_colour(c: list[Column]) -> list[Column]:
    """Into 0..1 towards the luminosity, which stays."""
    lum, low, high = luminosity(*c), F.least(*c), F.greatest(*c)
    up = [F.when(low < 0, lum + (x - lum) * lum / F.greatest(lum - low, F.lit(1e-12))).otherwise(x) for x in c]
    return [F.when(high > 1, lum + (u - lum) * (1.0 - lum) / F.greatest(high - lum, F.lit(1e-12))).otherwise(u) for u in up]


def _with_luminosity(c: list[Column], lum: Column) -> list[Column]:
    d = lum - luminosity(*c)
    return _clip_colour([x + d for x in c])


def _saturation(c: list[Column]) -> Column:
    return F.greatest(*c) - F.least(*c)


def _with_saturation(c: list[Column], sat: Column) -> list[Column]:
    low, width = F.least(*c), _saturation(c)
    return [F.when(width > 0, (x - low) * sat / F.greatest(width, F.lit(1e-12))).otherwise(0.0) for x in c]


COLOUR_MODES = ("Hue", "Saturation", "Color", "Luminosity")


def blend_colour(mode: str, b: list[Column], s: list[Column]) -> list[Column]:
    """Non-separable blend of backdrop and source, each three Columns in 0..1."""
    return {
        "Hue": lambda: _with_luminosity(_with_saturation(s, _saturation(b)), luminosity(*b)),
        "Saturation": lambda: _with_luminosity(_with_saturation(b, _saturation(s)), luminosity(*b)),
        "Color": lambda: _with_luminosity(s, luminosity(*b)),
        "Luminosity": lambda: _with_luminosity(b, luminosity(*s)),
    }[mode]()


def nearest_index(i: Column, source: int, target: int) -> Column:
    """Index in ``source`` samples nearest to sample i of ``target``."""
    return F.least(F.lit(source - 1), F.floor((i + 0.5) * source / target)).cast("int")


def compensate_black(y: Column, source_black: float, target_black: float) -> Column:
    """Scale so that the source's black meets the target's and white stays at 1."""
    scale = (1.0 - target_black) / (1.0 - source_black)
    return y * scale + (1.0 - scale)


def stitched_unordered(x: Column, parts: list, bounds: list[float], encode: list[tuple[float, float]], domain: tuple[float, float] = (0, 1)) -> Column:
    """A stitched function whose bounds need not ascend: the part of the first bound above the value."""
    x = clamp(x, *domain)
    ends = [domain[0], *bounds, domain[1]]
    pieces = []
    for i, part in enumerate(parts):
        low, high, (e0, e1) = ends[i], ends[i + 1], encode[i]
        pieces.append(part(F.lit(float(e0)) if high == low else F.lit(float(e0)) + (x - low) * (e1 - e0) / (high - low)))
    out = pieces[-1]
    for bound, piece in reversed(list(zip(bounds, pieces))):
        out = F.when(x < bound, piece).otherwise(out)
    return out
