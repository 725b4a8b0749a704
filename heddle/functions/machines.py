"""Small bytecode machines, run over whole columns of inputs at once.

One program runs for many inputs in lockstep: memory is a (rows, cells) array, every
step groups the rows by program counter, so an instruction is executed once for all rows
that stand at it.  Rows that halt leave the active set.  Assemblers turn text into bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATA, CYCLES = 8, 1_000_000

# Opcodes of the three machines; the assemblers' operand kinds are r(egister) and n(umber).
REGISTER_OPS = {"load": (1, "rn"), "store": (2, "rn"), "add": (3, "rr"), "sub": (4, "rr"), "addi": (5, "rn"), "subi": (6, "rn"), "jump": (7, "n"), "beqz": (8, "rn"), "halt": (255, "")}
STACK_OPS = {"push": (1, "n"), "store": (2, "n"), "add": (3, ""), "sub": (4, ""), "pushi": (5, "n"), "pop": (6, ""), "jump": (7, "n"), "beqz": (8, "n"), "halt": (255, "")}
STACK_LENGTHS = {1: 2, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1, 7: 2, 8: 2}
WORD_LOAD, WORD_STORE, WORD_ADD, WORD_SUB, WORD_BRANCH, WORD_HALT = 1, 2, 3, 4, 5, 255


class MachineError(ValueError):
    """A program that a machine cannot run: an unknown instruction or an empty stack."""


def assemble(text: str, ops: dict[str, tuple[int, str]]) -> bytes:
    """One instruction a line, operands separated by blanks."""
    out = bytearray()
    for line in filter(None, map(str.strip, text.strip().split("\n"))):
        name, *args = line.split()
        if name not in ops or len(args) != len(ops[name][1]):
            raise MachineError(f"cannot assemble {line!r}")
        code, kinds = ops[name]
        out.append(code)
        out += bytes(int(a[1:]) if k == "r" else int(a) & 255 for a, k in zip(args, kinds))
    return bytes(out)


def memory_of(program: bytes, inputs: list[np.ndarray], at: int = DATA, size: int = 258) -> np.ndarray:
    """Inputs go to cells 1, 2, ..; two spare cells stand behind the 256 for operands that hang over."""
    rows = len(inputs[0])
    memory = np.zeros((rows, size), dtype=np.int64)
    for k, column in enumerate(inputs, 1):
        memory[:, k] = np.asarray(column, dtype=np.int64) & 255
    memory[:, at : at + len(program)] = np.frombuffer(program, dtype=np.uint8)
    return memory


def lockstep(memory: np.ndarray, start: int, step: Callable[[np.ndarray, int], np.ndarray]) -> None:
    """step(rows, pc) runs the instruction at pc for these rows and returns each one's next pc, -1 to halt."""
    pc = np.full(len(memory), start, dtype=np.int64)
    for _ in range(CYCLES):
        active = np.nonzero(pc >= 0)[0]
        if not len(active):
            return
        for at in np.unique(pc[active]):
            rows = active[pc[active] == at]
            pc[rows] = step(rows, int(at))
    raise MachineError("the program did not halt")


def by_code(memory: np.ndarray, rows: np.ndarray, at: int, width: int):
    """Rows grouped by what stands in their memory at pc: programs may have changed themselves."""
    stands = memory[rows, at : at + width]
    if (stands == stands[0]).all():
        yield np.arange(len(rows)), stands[0].tolist()
        return
    seen, which = np.unique(stands, axis=0, return_inverse=True)
    for k, code in enumerate(seen):
        yield np.nonzero(which.reshape(-1) == k)[0], [int(x) for x in code]


def run_register(memory: np.ndarray) -> np.ndarray:
    """Two 8-bit registers, instructions of three bytes; returns cell 0."""
    registers = np.zeros((len(memory), 3), dtype=np.int64)

    def step(rows: np.ndarray, pc: int) -> np.ndarray:
        out = np.full(len(rows), pc + 3 if pc < 253 else -1, dtype=np.int64)
        for part, (op, a, b) in by_code(memory, rows, pc, 3):
            mine = rows[part]
            if op == 1:
                registers[mine, a] = memory[mine, b]
            elif op == 2:
                memory[mine, b] = registers[mine, a]
            elif op in (3, 4):
                registers[mine, a] = (registers[mine, a] + (1 if op == 3 else -1) * registers[mine, b]) & 255
            elif op in (5, 6):
                registers[mine, a] = (registers[mine, a] + (b if op == 5 else -b)) & 255
            elif op == 7:
                out[part] = a
            elif op == 8:
                landed = (pc + b) & 255
                taken = -1 if landed >= 253 else landed + 3
                out[part] = np.where(registers[mine, a] == 0, taken, out[part])
            elif op == 255:
                out[part] = -1
        return out

    lockstep(memory, DATA, step)
    return memory[:, 0]


def run_stack(memory: np.ndarray) -> np.ndarray:
    """A stack of bytes, instructions of one or two bytes; returns cell 0."""
    stack, top = np.zeros((len(memory), 1024), dtype=np.int64), np.zeros(len(memory), dtype=np.int64)

    def need(rows: np.ndarray, n: int) -> None:
        if (top[rows] < n).any():
            raise MachineError(f"an instruction needs {n} items on the stack")

    def push(rows: np.ndarray, values) -> None:
        stack[rows, top[rows]] = values
        top[rows] += 1

    def step(rows: np.ndarray, pc: int) -> np.ndarray:
        out = np.full(len(rows), -1, dtype=np.int64)
        for part, (op, arg) in by_code(memory, rows, pc, 2):
            mine = rows[part]
            if op == 255:
                continue
            if op not in STACK_LENGTHS:
                raise MachineError(f"unknown instruction {op}")
            onward = lambda at, n=STACK_LENGTHS[op]: -1 if at == 255 or at == 254 and n > 1 else at + n
            out[part] = onward(pc)
            if op == 1:
                push(mine, memory[mine, arg])
            elif op == 5:
                push(mine, arg)
            elif op == 2:
                need(mine, 1)
                top[mine] -= 1
                memory[mine, arg] = stack[mine, top[mine]]
            elif op in (3, 4):
                need(mine, 2)
                top[mine] -= 1
                upper, lower = stack[mine, top[mine]], stack[mine, top[mine] - 1]
                stack[mine, top[mine] - 1] = (upper + lower if op == 3 else upper - lower) & 255
            elif op == 6:
                need(mine, 1)
                top[mine] -= 1
            elif op == 7:
                out[part] = arg
            elif op == 8:
                need(mine, 1)
                out[part] = np.where(stack[mine, top[mine] - 1] == 0, onward((pc + arg) & 255), out[part])
        return out

    lockstep(memory, DATA, step)
    return memory[:, 0]


def run_word(memory: np.ndarray) -> np.ndarray:
    """16-bit registers, little-endian words; the low four bits of an instruction say what, the rest how or where to."""
    registers = np.zeros((len(memory), 3), dtype=np.int64)

    def step(rows: np.ndarray, pc: int) -> np.ndarray:
        out = np.full(len(rows), pc + 3, dtype=np.int64)
        for part, (op, a, b) in by_code(memory, rows, pc, 3):
            mine, kind, more = rows[part], op & 15, op >> 4
            if op == WORD_HALT:
                out[part] = -1
            elif kind == WORD_LOAD:
                registers[mine, a] = memory[mine, b] + (memory[mine, b + 1] << 8)
            elif kind == WORD_STORE:
                memory[mine, b], memory[mine, b + 1] = registers[mine, a] & 255, registers[mine, a] >> 8
            elif kind == WORD_ADD and more in (0, 1):
                registers[mine, a] = (registers[mine, a] + (b if more else registers[mine, b])) & 0xFFFF
            elif kind == WORD_SUB:
                registers[mine, a] = (registers[mine, a] - registers[mine, b]) & 0xFFFF
            elif kind == WORD_BRANCH:
                out[part] = np.where(registers[mine, a] == registers[mine, b], more, out[part])
            else:
                raise MachineError(f"unknown instruction {op}")
        return out

    lockstep(memory, 0, step)
    return memory


def machine_column(program: bytes, run: Callable[[np.ndarray], np.ndarray]):
    """A column function of (x, y): the program's answer for inputs in cells 1 and 2; null if one is null."""

    @F.pandas_udf(T.IntegerType())
    def answer(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(run(memory_of(program, [x.to_numpy(), y.to_numpy()])).astype("int32"))

    return where_given(answer)


def where_given(answer: Callable) -> Callable:
    """The column function with null where an argument is null; the machine runs on zeros there."""

    def column(*inputs):
        given = reduce(lambda a, b: a & b, [x.isNotNull() for x in inputs])
        return F.when(given, answer(*[F.coalesce(x, F.lit(0)).cast("long") for x in inputs]))

    return column


def word_column(program: bytes, inputs: tuple[int, ...], output: int):
    """A column function: arguments go as 16-bit words to the cells ``inputs``, the answer comes from ``output``."""

    @F.pandas_udf(T.IntegerType())
    def answer(*columns: pd.Series) -> pd.Series:
        memory = memory_of(program, [np.zeros(len(columns[0]), dtype=np.int64)], at=0)
        for at, column in zip(inputs, columns):
            values = column.to_numpy(dtype=np.int64)
            memory[:, at], memory[:, at + 1] = values & 255, values >> 8 & 255
        run_word(memory)
        return pd.Series((memory[:, output] + (memory[:, output + 1] << 8)).astype("int32"))

    return where_given(answer)
