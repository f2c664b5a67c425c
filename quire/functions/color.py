"""Colours: components to 8-bit RGB, and ARGB packed in a bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def byte(x) -> Column:
    """0 to 1 as 0 to 255, rounded half up."""
    return F.floor(clamp(x) * 255 + 0.5).cast("int")


def rgb(r, g, b) -> Column:
    return F.struct(_c(r).cast("int").alias("r"), _c(g).cast("int").alias("g"), _c(b).cast("int").alias("b"))


def gray_to_rgb(v) -> Column:
    return rgb(byte(v), byte(v), byte(v))


def device_rgb(r, g, b) -> Column:
    return rgb(byte(r), byte(g), byte(b))


def cmyk_to_rgb(c, m, y, k) -> Column:
    rest = 1 - clamp(k)
    return rgb(*[byte((1 - clamp(x)) * rest) for x in (c, m, y)])


def cmyk8_to_rgb(c, m, y, k) -> Column:
    """Of bytes: what is left of 255 after ink and black."""
    return rgb(*[255 - F.least(F.lit(255), _c(x) + _c(k)) for x in (c, m, y)])


def _companded(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def xyz_to_rgb(x, y, z, gamma: bool = True) -> Column:
    """CIE XYZ (D65) to sRGB. The matrix holds fixed values of the sRGB standard."""
    x, y, z = _c(x), _c(y), _c(z)
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)
    return rgb(*[byte(_companded(clamp(v)) if gamma else v) for v in linear])


def cal_gray_to_rgb(v, gamma=1.0, white=(0.9505, 1.0, 1.089)) -> Column:
    level = F.pow(clamp(v), _c(gamma))
    return xyz_to_rgb(*[level * w for w in white])


def lab_to_rgb(lightness, a, b, white=(0.9505, 1.0, 1.089), gamma: bool = True) -> Column:
    m = (_c(lightness) + 16) / 116

    def g(v: Column) -> Column:
        return F.when(v >= 6 / 29, v * v * v).otherwise(108 / 841 * (v - 4 / 29))

    return xyz_to_rgb(g(m + _c(a) / 500) * white[0], g(m) * white[1], g(m - _c(b) / 200) * white[2], gamma)


def indexed_to_rgb(index, palette: Column) -> Column:
    """palette: binary of RGB triples. The index is clamped to 0 from below; past the end is black."""
    at = F.greatest(_c(index).cast("int"), F.lit(0)) * 3

    def part(k: int) -> Column:
        return F.conv(F.hex(F.substring(palette, at + 1 + k, F.lit(1))), 16, 10).cast("int")

    return F.when(at + 3 <= F.length(palette), rgb(part(0), part(1), part(2))).otherwise(rgb(0, 0, 0))


def separation_to_rgb(name, tint, components: int) -> Column:
    """The tint in every component of an alternate space of 1, 3 or 4; All is gray, None is null."""
    same = {1: gray_to_rgb(tint), 3: device_rgb(tint, tint, tint), 4: cmyk_to_rgb(tint, tint, tint, tint)}[components]
    return F.when(_c(name) == "None", None).when(_c(name) == "All", gray_to_rgb(1 - clamp(tint))).otherwise(same)


def device_n_to_rgb(tints: Column, components: int) -> Column:
    mean = F.aggregate(tints, F.lit(0.0), lambda s, v: s + v) / F.size(tints)
    return separation_to_rgb("DeviceN", mean, components)


def decoded(v, low, high) -> Column:
    """The decode array of an image: 0 to 1 onto low to high."""
    return _c(low) + _c(v) * (_c(high) - _c(low))


def argb(a, r, g, b) -> Column:
    a, r, g, b = (_c(x).cast("long").bitwiseAND(255) for x in (a, r, g, b))
    return F.shiftleft(a, 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def channel(color, name: str) -> Column:
    return F.shiftright(_c(color).cast("long"), {"a": 24, "r": 16, "g": 8, "b": 0}[name]).bitwiseAND(255).cast("int")


def luminance(r, g, b) -> Column:
    """Whole numbers: thousandths, cut."""
    return F.floor((_c(r) * 299 + _c(g) * 587 + _c(b) * 114) / 1000).cast("int")


def source_over(dst, src, cover=255) -> Column:
    """Packed ARGB over packed ARGB, straight alpha scaled by a coverage; the result is opaque."""
    alpha = F.floor(channel(src, "a") * _c(cover) / 255)

    def part(name: str) -> Column:
        s, d = channel(src, name), channel(dst, name)
        return F.floor((s * alpha + d * (255 - alpha)) / 255)

    return argb(255, part("r"), part("g"), part("b"))


def composited(layers: Column, dst) -> Column:
    """array<struct<z, color>> laid over ``dst`` from the least z: an ordered fold, for each pixel's few layers."""
    return F.aggregate(F.array_sort(layers), _c(dst).cast("long"), lambda d, s: source_over(d, s["color"]))


def premultiplied(color) -> Column:
    a = channel(color, "a")
    return argb(a, *[F.floor((channel(color, n) * a + 127) / 255) for n in "rgb"])


def ycc_to_rgb(y, cb, cr) -> Column:
    """JPEG luma and chroma bytes. The factors are fixed values of the standard."""
    y, cb, cr = _c(y), _c(cb) - 128, _c(cr) - 128

    def cut(v: Column) -> Column:
        return clamp(F.floor(v + 0.5), 0, 255)

    return rgb(cut(y + 1.402 * cr), cut(y - 0.344136 * cb - 0.714136 * cr), cut(y + 1.772 * cb))


def reversible_forward(r, g, b) -> Column:
    """The reversible component transform: struct<y, u, v>."""
    r, g, b = _c(r), _c(g), _c(b)
    return F.struct(F.floor((r + 2 * g + b) / 4).cast("int").alias("y"), (b - g).cast("int").alias("u"), (r - g).cast("int").alias("v"))


def reversible_inverse(t: Column) -> Column:
    g = t["y"] - F.floor((t["u"] + t["v"]) / 4).cast("int")
    return rgb(t["v"] + g, g, t["u"] + g)


def in_color_key(components: Column, lows: Column, highs: Column) -> Column:
    """Whether every component is within its range; false if the lengths differ."""
    inside = F.forall(F.zip_with(F.arrays_zip(components.alias("c"), lows.alias("l")), highs, lambda x, h: (x["c"] >= x["l"]) & (x["c"] <= h)), lambda b: b)
    return (F.size(components) == F.size(lows)) & (F.size(lows) == F.size(highs)) & F.coalesce(inside, F.lit(False))


#: Colour spaces by name, and their numbers of components.
SPACES = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1, "Separation": 1, "Pattern": 0}
LONG_NAMES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def space_of(name: Column) -> Column:
    """struct<space, components> of a space's name or the first element of its array; null if it is unknown. ICCBased and DeviceN have as many as they say."""
    whole = F.coalesce(F.create_map(*[F.lit(x) for pair in LONG_NAMES.items() for x in pair])[name], name)
    count = F.create_map(*[F.lit(x) for pair in SPACES.items() for x in pair])[name]
    return F.when(name.isin(*SPACES, "ICCBased", "DeviceN"), F.struct(whole.alias("space"), count.alias("components")))


def icc_alternate(alternate: Column, components: Column) -> Column:
    """The space that stands in for a profile: its alternate, else the device space of as many components."""
    return F.coalesce(alternate, F.when(components == 1, "DeviceGray").when(components == 3, "DeviceRGB").when(components == 4, "DeviceCMYK"))


def icc_to_rgb(parts: Column, components: Column) -> Column:
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(0.0))
    return F.when(components == 1, gray_to_rgb(at(0))).when(components == 3, device_rgb(at(0), at(1), at(2))).when(components == 4, cmyk_to_rgb(at(0), at(1), at(2), at(3)))


def cal_rgb_to_rgb(a, b, c, compat: bool = True, gamma=(1.0, 1.0, 1.0), matrix=(0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505)) -> Column:
    """compat: parameters are ignored and the components taken as device ones; else by gamma and matrix to XYZ."""
    if compat:
        return device_rgb(a, b, c)
    parts = [F.pow(clamp(v), F.lit(float(g))) for v, g in zip((a, b, c), gamma, strict=True)]
    return xyz_to_rgb(*[sum((p * matrix[3 * k + j] for k, p in enumerate(parts)), F.lit(0.0)) for j in range(3)])


def pattern_to_rgb(underlying: Column) -> Column:
    """The colour of an uncolored pattern's underlying space, else black."""
    return F.coalesce(underlying, rgb(0, 0, 0))


def demultiplied(color) -> Column:
    """Straight alpha of a premultiplied colour; without alpha all is zero."""
    a = channel(color, "a")
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(argb(a, *[F.least(F.floor(channel(color, n) * 255 / a), F.lit(255)) for n in "rgb"]))


def gradient(first, second, share) -> Column:
    """A colour between two, channel by channel, rounded to the nearest; share: 0 to 1."""
    parts = [F.floor(channel(first, n) + (channel(second, n) - channel(first, n)) * _c(share) + 0.5) for n in "argb"]
    return argb(*parts)


def multiplied_bytes(a: Column, b: Column) -> Column:
    """Of two bytes as shares of 255, rounded."""
    t = a * b + 128
    return F.shiftright(F.shiftright(t, 8) + t, 8).cast("int")


def sycc_to_rgb(y, cb, cr, bits: int = 8) -> Column:
    """Components of so many bits, chroma offset by half the range; the result in as many bits, clamped and cut."""
    half, most = 1 << (bits - 1), (1 << bits) - 1
    u, v = _c(cb) - half, _c(cr) - half
    parts = (_c(y) + 1.402 * v, _c(y) - 0.344 * u - 0.714 * v, _c(y) + 1.772 * u)
    return rgb(*[F.greatest(F.least(p.cast("int"), F.lit(most)), F.lit(0)) for p in parts])


def to_byte(value: Column, bits: int, signed: bool = False) -> Column:
    """A component of so many bits as a byte: shifted down, or spread up over the whole range."""
    v = value + (1 << (bits - 1)) if signed else value
    return (F.shiftright(v, bits - 8) if bits > 8 else F.floor(v * 255 / ((1 << bits) - 1))).cast("int")


def ycck_to_rgb(y, cb, cr, k) -> Column:
    """Inverted CMYK behind a luma-chroma transform: RGB of the first three, scaled by the fourth as light."""
    plain = ycc_to_rgb(y, cb, cr)
    return rgb(*[F.floor(plain[n] * _c(k) / 255).cast("int") for n in "rgb"])


#: Wavelengths in nanometres between which the colours of the spectrum change: violet, blue, cyan, green, yellow, red, end.
SPECTRUM = (380, 440, 490, 510, 580, 645, 780)


def wavelength_to_rgb(nm: Column, gamma: float = 1.0) -> Column:
    """struct<r, g, b> of doubles from 0 to 1: straight lines between the spectrum's bounds, dimmer at both ends; outside of it black."""
    violet, blue, cyan, green, yellow, red, end = (float(x) for x in SPECTRUM)

    def line(low: float, high: float) -> Column:
        return (nm - low) / (high - low)

    def within(low: float, high: float) -> Column:
        return (nm >= low) & (nm <= high)

    r = F.when(within(violet, blue), 1 - line(violet, blue)).when(within(green, yellow), line(green, yellow)).when(within(yellow, end), 1.0).otherwise(0.0)
    g = F.when(within(blue, cyan), line(blue, cyan)).when(within(cyan, yellow), 1.0).when(within(yellow, red), 1 - line(yellow, red)).otherwise(0.0)
    b = F.when(within(violet, cyan), 1.0).when(within(cyan, green), 1 - line(cyan, green)).otherwise(0.0)
    dim = F.when(nm > 700, 0.3 + 0.7 * (end - nm) / 80).when(nm < 420, 0.3 + 0.7 * (nm - violet) / 40).otherwise(1.0)
    return F.struct(*[F.pow(F.greatest(c * dim, F.lit(0.0)), F.lit(gamma)).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])
