"""Names: namespaces, silence and prefixes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a run-time symbol, by beginning, by namespace and by whole name.
RUNTIME_PREFIXES = ["__cxa_", "__gxx_", "__cxx_", "__clang_", "__libc_", "__glibc_"]
RUNTIME_NAMESPACES = ["__gnu_cxx", "__cxxabiv1"]
RUNTIME_NAMES = ["__dso_handle", "__tls_get_addr"]
#: The beginnings of struct names.
STRUCT_PREFIX = r"^(struct|class|union|enum)\."


def _depths(name: Column) -> Column:
    """For each character, how many ``<`` are open before it (an array of ints)."""
    chars = F.split(name, "")
    step = lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + F.when(c == "<", 1).when(c == ">", -1).otherwise(0))
    return F.aggregate(chars, F.array(F.lit(0)), step)


def separators(name: Column) -> Column:
    """Places (from 0) of every ``::`` that is not inside ``<...>``."""
    depth = _depths(name)
    places = F.sequence(F.lit(0), F.greatest(F.length(name) - 2, F.lit(0)))
    open_at = lambda i: F.get(depth, i) == 0
    inside = F.filter(places, lambda i: (F.substring(name, i + 1, 2) == "::") & open_at(i))
    return F.when(F.length(name) < 2, F.array().cast("array<int>")).when(~name.contains("<"), F.filter(places, lambda i: F.substring(name, i + 1, 2) == "::")).otherwise(inside)


def namespace(name: Column) -> Column:
    """What stands before the first ``::`` outside ``<...>``; empty without one."""
    at = F.get(separators(name), F.lit(0))
    return F.when(at.isNull(), "").otherwise(F.substring(name, F.lit(1), at))


def ns_suffixes(name: Column) -> Column:
    """The name and each form of it with one more namespace taken off: ``A::B::f``, ``B::f``, ``f``."""
    return F.concat(F.array(name), F.transform(separators(name), lambda i: F.substring(name, i + 3, F.length(name))))


def stripped(name: Column) -> Column:
    """The name without any namespace."""
    return F.element_at(ns_suffixes(name), -1)


def struct_stripped(name: Column) -> Column:
    """A struct's name without ``struct.`` and the like, and without the last ``.N``."""
    return F.regexp_replace(F.regexp_replace(name, STRUCT_PREFIX, ""), r"\.[^.]*$", "")


def silenced(demangled: Column, std: bool = True, llvm: bool = True, runtime: bool = True) -> Column:
    """Whether a symbol belongs to the standard library, the compiler or the run time, as far as each is silenced."""
    ns = namespace(demangled)
    out = F.lit(False)
    if std:
        out = out | (ns == "std")
    if llvm:
        out = out | (ns == "llvm")
    if runtime:
        out = out | demangled.rlike("^(" + "|".join(RUNTIME_PREFIXES) + ")") | ns.isin(RUNTIME_NAMESPACES) | demangled.isin(RUNTIME_NAMES)
    return out


def spawns(name: Column) -> Column:
    """Whether a function starts another thread of work, by its name (fixed values)."""
    return (name == "pthread_create") | name.contains("spawn") | name.contains("thread")


def intrinsic(name: Column) -> Column:
    return name.startswith("llvm.")


def bare(name: Column) -> Column:
    """Without one leading ``@`` or ``%``."""
    return F.regexp_replace(name, "^[@%]", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strict_int(text: Column) -> Column:
    """An int if the whole text is one, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
