"""An interactive shell over an engine: statements, and CD and PWD for relative paths. `python -m skein.shell FOLDER`"""

from __future__ import annotations

import sys

PATH_VERBS = ("CAT", "TEE", "LS", "CP", "MV", "UNLINK")


def resolve(cwd: str, path: str) -> str:
    """An absolute path, with `.` and `..` taken away."""
    out: list[str] = []
    for part in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def rewrite(cwd: str, line: str) -> str:
    """The statement with its paths made absolute."""
    words = line.split(" ")
    verb = words[0].upper().split("[")[0]
    if verb in PATH_VERBS:
        count = 2 if verb in ("CP", "MV") else 1
        if len(words) == 1:
            words.append(cwd)
        for k in range(1, min(count, len(words) - 1) + 1):
            words[k] = resolve(cwd, words[k])
    return " ".join(words)


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from skein.operators.engine import Engine

    engine, cwd = Engine(SparkSession.builder.getOrCreate(), folder), "/"
    for line in sys.stdin:
        words = line.split()
        if not words:
            continue
        if words[0].upper() == "PWD":
            print(cwd)
        elif words[0].upper() == "CD":
            cwd = resolve(cwd, words[1] if len(words) > 1 else "/")
        elif words[0].upper() in ("EXIT", "QUIT"):
            return
        else:
            code, rows = engine.query(rewrite(cwd, line.strip()))
            print(code)
            if rows is not None:
                rows.show(100, truncate=256)


if __name__ == "__main__":
    main(sys.argv[1])
