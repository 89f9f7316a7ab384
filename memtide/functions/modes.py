"""Mode flags of directory entries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sixteen mode bits, and the letter of each of the first fifteen.
READ, WRITE, EXECUTE, PROTECTED = 0x0001, 0x0002, 0x0004, 0x0008
FILE, DIR, O_DCREAT, UNKNOWN_80 = 0x0010, 0x0020, 0x0040, 0x0080
UNKNOWN_100, O_CREAT, UNKNOWN_400, POCKETSTATION = 0x0100, 0x0200, 0x0400, 0x0800
PSX, HIDDEN, UNKNOWN_4000, EXISTS = 0x1000, 0x2000, 0x4000, 0x8000
LETTERS = "rwxpfdD81C+KPH4"

RWX = READ | WRITE | EXECUTE
NEW_DIR = RWX | DIR | UNKNOWN_400 | EXISTS
NEW_FILE = RWX | FILE | UNKNOWN_400 | EXISTS
#: Bits that a mode change never touches.
KIND = FILE | DIR | EXISTS


def has(mode: Column, bits: int) -> Column:
    return mode.bitwiseAND(F.lit(bits)) != 0


def exists(mode: Column) -> Column:
    return has(mode, EXISTS)


def is_file(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(KIND)) == EXISTS | FILE


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(KIND)) == EXISTS | DIR


def mode_string(mode: Column) -> Column:
    """Fifteen letters, a dash for each bit that is not set."""
    return F.concat(*[F.when(has(mode, 1 << i), F.lit(c)).otherwise(F.lit("-")) for i, c in enumerate(LETTERS)])


def protection(mode: Column) -> Column:
    """The label of a save: by its PlayStation bits, else by its protected and write bits."""
    bits = mode.bitwiseAND(F.lit(PROTECTED | WRITE))
    return (
        F.when(has(mode, PSX), F.when(has(mode, POCKETSTATION), F.lit("PocketStation")).otherwise(F.lit("PlayStation")))
        .when(bits == 0, F.lit("Delete Protected"))
        .when(bits == WRITE, F.lit("Not Protected"))
        .when(bits == PROTECTED, F.lit("Copy & Delete Protected"))
        .otherwise(F.lit("Copy Protected"))
    )


def merged(old: Column, new: Column) -> Column:
    """``new`` with the kind bits of ``old``."""
    return new.bitwiseAND(F.lit(0xFFFF & ~KIND)).bitwiseOR(old.bitwiseAND(F.lit(KIND)))


def change(old: Column, set_bits: int = 0, clear_bits: int = 0) -> Column:
    return merged(old, old.bitwiseOR(F.lit(set_bits)).bitwiseAND(F.lit(0xFFFF & ~clear_bits)))


def swapped(mode: Column) -> Column:
    """The two bytes of a mode exchanged, as one container stores it."""
    return F.shiftleft(mode.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(mode, 8).bitwiseAND(F.lit(255)))
