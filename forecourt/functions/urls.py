"""Addresses, file names, checksums and hash distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions import fixed


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def absolute_url(url: Column | str, base: str | Column) -> Column:
    """Complete an address found on a page: add the scheme, or the base of its site."""
    link, root = _c(url), F.lit(base) if isinstance(base, str) else base
    return (
        F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(~F.startswith(link, F.lit("http")), F.concat(root, F.lit("/"), link))
        .otherwise(link)
    )


def url_path(url: Column | str) -> Column:
    """Path of an address without query and fragment; never fails on malformed ones."""
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def base_name(path: Column) -> Column:
    """Text after the last slash; empty when the path ends with one."""
    return F.substring_index(path, "/", -1)


def last_segment(path: Column) -> Column:
    """Last non-empty segment of a path."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def source_site_and_id(url: Column | str) -> Column:
    """Host and last path segment: the natural key of an ad taken from its address."""
    return F.struct(url_host(url).alias("source_site"), last_segment(url_path(url)).alias("source_id"))


def url_hash(url: Column | str) -> Column:
    return F.md5(_c(url))


def image_extension(url: Column) -> Column:
    """Extension an address suggests by naming an image type anywhere."""
    low = F.lower(url)
    return (
        F.when(F.contains(low, F.lit("jpg")) | F.contains(low, F.lit("jpeg")), F.lit(".jpg"))
        .when(F.contains(low, F.lit("png")), F.lit(".png"))
        .when(F.contains(low, F.lit("webp")), F.lit(".webp"))
        .otherwise(F.lit(".jpg"))
    )


def image_filename(url: Column | str, source_id: Column | str) -> Column:
    """File name in the address, or one made of the source id and a hash of the address."""
    link = _c(url)
    name = base_name(url_path(link))
    made = F.concat(_c(source_id), F.lit("_"), F.substring(F.md5(link), 1, 8), image_extension(link))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(made)


def download_filename(url: Column | str, source_id: Column | str) -> Column:
    """Older naming: a folder per source, always with a known image extension."""
    link = _c(url)
    name = base_name(url_path(link))
    made = F.concat(_c(source_id), F.lit("_"), F.substring(F.md5(link), 1, 8), F.lit(".jpg"))
    chosen = F.when(F.contains(name, F.lit(".")), name).otherwise(made)
    known = F.rlike(F.lower(chosen), F.lit(r"\.(" + "|".join(fixed.DOWNLOAD_EXTENSIONS) + ")$"))
    return F.concat(_c(source_id), F.lit("/"), chosen, F.when(known, F.lit("")).otherwise(F.lit(".jpg")))


def gallery_filename(url: Column | str) -> Column:
    """Name of a gallery file, ``image`` without one, with a known image extension."""
    name = last_segment(url_path(url))
    chosen = F.when(name == "", F.lit("image")).otherwise(name)
    known = F.rlike(F.lower(chosen), F.lit(r"\.(" + "|".join(fixed.DOWNLOAD_EXTENSIONS) + ")$"))
    return F.concat(chosen, F.when(known, F.lit("")).otherwise(F.lit(".jpg")))


def checksum(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def content_path(root: str, digest: Column, name: Column) -> Column:
    """Place of a file by its checksum: two levels of two hex digits."""
    return F.concat_ws("/", F.lit(root), F.substring(digest, 1, 2), F.substring(digest, 3, 2), name)


def numbered_name(name: Column, copy: Column) -> Column:
    """``a.jpg`` for copy 0, ``a-1.jpg`` for copy 1, and so on."""
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    suffix = F.substring(name, F.length(stem) + 1, F.length(name))
    return F.when(copy == 0, name).otherwise(F.concat(stem, F.lit("-"), copy.cast("string"), suffix))


def is_car_image(url: Column | str) -> Column:
    """An address that names no skipped thing and names something car related."""
    low = F.lower(_c(url))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return ~has(fixed.NOT_CAR_IMAGE_WORDS) & has(fixed.CAR_IMAGE_WORDS)


def is_real_picture(src: Column | str) -> Column:
    low = F.lower(_c(src))
    return ~F.contains(low, F.lit("icon")) & ~F.contains(low, F.lit("placeholder"))


def has_image_extension(path: Column | str) -> Column:
    return F.rlike(F.lower(_c(path)), F.lit(r"\.(" + "|".join(fixed.IMAGE_EXTENSIONS) + ")$"))


def best_source(srcset: Column | str) -> Column:
    """Best candidate of a srcset: the largest width, with densities counted as thousands of pixels."""
    parts = F.filter(F.transform(F.split(_c(srcset), ","), lambda p: F.trim(p)), lambda p: p != "")

    def weighed(part: Column) -> Column:
        bits = F.split(part, r"\s+")
        size = F.coalesce(F.get(bits, F.lit(1)), F.lit(""))
        number = F.substring(size, F.lit(1), F.greatest(F.length(size) - 1, F.lit(0)))
        weight = (
            F.when(F.endswith(size, F.lit("w")), number.try_cast("int"))
            .when(F.endswith(size, F.lit("x")), (number.try_cast("double") * 1000).try_cast("int"))
        )
        return F.struct(F.coalesce(weight, F.lit(0)).alias("weight"), bits[0].alias("url"))

    return F.array_max(F.transform(parts, weighed))["url"]


def best_image_url(srcset: Column, *fallbacks: Column) -> Column:
    """The best srcset candidate, else the first given plain address."""
    return F.coalesce(best_source(srcset), *[F.nullif(f, F.lit("")) for f in fallbacks])


DIGITS_PER_WORD = 15


def hash_words(hex_hash: Column | str, digits: int) -> Column:
    """A hex hash of known length as an array of 60-bit words, for bit operations."""
    text = F.lower(_c(hex_hash))
    return F.array(*[
        F.conv(F.substring(text, start, min(DIGITS_PER_WORD, digits - start + 1)), 16, 10).cast("bigint")
        for start in range(1, digits + 1, DIGITS_PER_WORD)
    ])


def word_distance(a: Column, b: Column, digits: int) -> Column:
    """Differing bits of two hash word arrays."""
    total = F.lit(0)
    for i in range(len(range(1, digits + 1, DIGITS_PER_WORD))):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def hamming_distance(a: Column | str, b: Column | str, digits: int) -> Column:
    return word_distance(hash_words(a, digits), hash_words(b, digits), digits)
