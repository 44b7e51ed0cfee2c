"""VTK files as a PySpark data source: XML PolyData (.vtp), legacy files (.vtk), and multi-block indexes (.vtm).

spark.read.format("kf_vtk").option("path", pattern), or option paths with one a line, gives a row for each point (option association=cell: for each cell), with t (the last
number in the file name), row_idx, points and the arrays; vectors are array<double>. A partition per file.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kernelfield.sources import files

_TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
_LEGACY = {"char": "i1", "unsigned_char": "u1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4", "long": "i8", "unsigned_long": "u8", "float": "f4", "double": "f8", "vtktypeint64": "i8", "vtkidtype": "i8"}


def file_type(path: str) -> str:
    """'xml' or 'legacy', by the first 100 bytes."""
    head = files.content(path, 100).lstrip()
    if head.startswith(b"<?xml") or head.startswith(b"<VTKFile"):
        return "xml"
    if head.lower().startswith(b"# vtk"):
        return "legacy"
    raise ValueError(f"{path} is no VTK file")


def _decoded(raw: bytes, dtype: str, header: str, compressed: bool) -> np.ndarray:
    """Array data after its header of sizes."""
    word = np.dtype(header).itemsize
    if not compressed:
        n = int(np.frombuffer(raw, header, 1)[0])
        return np.frombuffer(raw, dtype, n // np.dtype(dtype).itemsize, word)
    blocks, _, _ = np.frombuffer(raw, header, 3).tolist()
    sizes = np.frombuffer(raw, header, blocks, 3 * word).tolist()
    at, out = (3 + blocks) * word, []
    for n in sizes:
        out.append(zlib.decompress(raw[at : at + n]))
        at += n
    return np.frombuffer(b"".join(out), dtype)


def _base64_array(text: str, dtype: str, header: str, compressed: bool) -> np.ndarray:
    text = "".join(text.split())
    word = np.dtype(header).itemsize
    if not compressed:
        return _decoded(base64.b64decode(text), dtype, header, False)
    first = -(-3 * word // 3) * 4
    blocks = int(np.frombuffer(base64.b64decode(text[:first])[:word], header)[0])
    length = -(-(3 + blocks) * word // 3) * 4  # the header is encoded by itself
    return _decoded(base64.b64decode(text[:length])[: (3 + blocks) * word] + base64.b64decode(text[length:]), dtype, header, True)


def read_xml(path: str, association: str = "point") -> dict[str, np.ndarray]:
    content = files.content(path)
    appended, mark = b"", content.find(b"<AppendedData")
    encoding = "base64"
    if mark >= 0:
        start = content.index(b"_", content.index(b">", mark)) + 1
        end = content.rindex(b"</AppendedData>")
        encoding = "raw" if b'"raw"' in content[mark : content.index(b">", mark)] else "base64"
        appended = content[start:end]
        content = content[:mark] + content[end + len(b"</AppendedData>") :]
    root = ET.fromstring(content)
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    header = order + _TYPES[root.get("header_type", "UInt32")]
    compressed = root.get("compressor") is not None

    def array(node: ET.Element) -> np.ndarray:
        dtype = order + _TYPES[node.get("type")]
        kind = node.get("format", "ascii")
        if kind == "ascii":
            flat = np.array((node.text or "").split(), dtype=np.float64 if "f" in dtype else np.int64).astype(dtype)
        elif kind == "binary":
            flat = _base64_array(node.text or "", dtype, header, compressed)
        else:
            rest = appended[int(node.get("offset")) :]
            flat = _decoded(rest, dtype, header, compressed) if encoding == "raw" else _base64_array(rest.decode("ascii", "ignore"), dtype, header, compressed)
        n = int(node.get("NumberOfComponents", "1"))
        return flat.reshape(-1, n) if n > 1 else flat

    pieces: dict[str, list[np.ndarray]] = {}
    for piece in root.iter("Piece"):
        if association == "point":
            points = piece.find("Points/DataArray")
            if points is not None:
                pieces.setdefault("points", []).append(array(points).reshape(-1, 3))
        data = piece.find("PointData" if association == "point" else "CellData")
        for node in data.findall("DataArray") if data is not None else ():
            pieces.setdefault(node.get("Name"), []).append(array(node))
    return {k: np.concatenate(v) for k, v in pieces.items()}


def read_legacy(path: str, association: str = "point") -> dict[str, np.ndarray]:
    content = files.content(path)
    lines = content.split(b"\n", 3)
    binary, at = lines[2].strip().upper() == b"BINARY", sum(len(x) + 1 for x in lines[:3])
    out: dict[str, np.ndarray] = {}
    where, n_rows = "", 0

    def line() -> list[str]:
        nonlocal at
        while at < len(content):
            end = content.find(b"\n", at)
            end = len(content) if end < 0 else end
            words = content[at:end].decode("ascii", "replace").split()
            at = end + 1
            if words:
                return words
        return []

    def values(n: int, kind: str) -> np.ndarray:
        nonlocal at
        dtype = np.dtype(">" + _LEGACY[kind.lower()])
        if binary:
            got = np.frombuffer(content, dtype, n, at)
            at += n * dtype.itemsize
            return got
        found: list[bytes] = []
        while len(found) < n and at < len(content):
            end = content.find(b"\n", at)
            end = len(content) if end < 0 else end
            found += content[at:end].split()
            at = end + 1
        return np.array(found[:n], np.float64 if dtype.kind == "f" else np.int64)

    while words := line():
        key = words[0].upper()
        if key == "POINTS":
            points = values(3 * int(words[1]), words[2]).reshape(-1, 3)
            if association == "point":
                out["points"] = points
        elif key in ("CELLS", "VERTICES", "LINES", "POLYGONS"):
            values(int(words[2]), "int")
        elif key == "CELL_TYPES":
            values(int(words[1]), "int")
        elif key in ("POINT_DATA", "CELL_DATA"):
            where, n_rows = key[:-5].lower(), int(words[1])
        elif key == "SCALARS":
            n = int(words[3]) if len(words) > 3 else 1
            mark = at
            if (line() or [""])[0].upper() != "LOOKUP_TABLE":
                at = mark
            got = values(n * n_rows, words[2])
            if where == association:
                out[words[1]] = got.reshape(-1, n) if n > 1 else got
        elif key in ("VECTORS", "NORMALS", "TENSORS"):
            n = 9 if key == "TENSORS" else 3
            got = values(n * n_rows, words[2]).reshape(-1, n)
            if where == association:
                out[words[1]] = got
        elif key == "FIELD":
            for _ in range(int(words[2])):
                name, n, rows, kind = line()
                got = values(int(n) * int(rows), kind)
                if where == association:
                    out[name] = got.reshape(-1, int(n)) if int(n) > 1 else got
    return out


def read(path: str, association: str = "point") -> dict[str, np.ndarray]:
    return read_xml(path, association) if file_type(path) == "xml" else read_legacy(path, association)


def blocks_of(path: str) -> list[str]:
    """The files of a multi-block index, in order, nested ones too."""
    out: list[str] = []
    for node in ET.fromstring(files.content(path)).iter("DataSet"):
        name = node.get("file")
        if name:
            own = os.path.join(os.path.dirname(path), name)
            out += blocks_of(own) if own.endswith(".vtm") else [own]
    return out


def step_of(path: str) -> int | None:
    found = re.findall(r"\d+", os.path.basename(path).rsplit(".", 1)[0])
    return int(found[-1]) if found else None


class _File(InputPartition):
    def __init__(self, path: str, t: int | None):
        self.path, self.t = path, t


class VtkReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int | None]], association: str, names: list[str]):
        self.files, self.association, self.names = files, association, names

    def partitions(self):
        return [_File(p, t) for p, t in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        arrays = read(partition.path, self.association)
        n = max((len(v) for v in arrays.values()), default=0)
        columns = [pa.array([partition.t] * n, pa.int32()), pa.array(np.arange(n))]
        for name in self.names[2:]:
            if name not in arrays:
                raise ValueError(f"{partition.path} has no array {name!r}; it has {', '.join(arrays)}")
            v = arrays[name]
            if v.ndim == 2:
                columns.append(pa.FixedSizeListArray.from_arrays(pa.array(v.astype(float).ravel()), v.shape[1]).cast(pa.list_(pa.float64())))
            else:
                columns.append(pa.array(v.astype(float if v.dtype.kind == "f" else np.int64)))
        yield pa.RecordBatch.from_arrays(columns, self.names)


class VtkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kf_vtk"

    def _files(self) -> list[tuple[str, int | None]]:
        named = self.options["paths"].split("\n") if "paths" in self.options else files.matching(self.options["path"])
        if not named:
            raise FileNotFoundError(self.options["path"])
        return [(b, step_of(p)) for p in named for b in (blocks_of(p) if p.endswith(".vtm") else [p])]

    def schema(self) -> str:
        arrays = read(self._files()[0][0], self.options.get("association", "point"))
        kinds = [f"`{k}` {'array<double>' if v.ndim == 2 else 'double' if v.dtype.kind == 'f' else 'bigint'}" for k, v in arrays.items()]
        return ", ".join(["t int", "row_idx bigint", *kinds])

    def reader(self, schema) -> VtkReader:
        return VtkReader(self._files(), self.options.get("association", "point"), schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(VtkSource)


def write_vtp(path: str, points: np.ndarray, arrays: dict[str, np.ndarray], association: str = "point", compressed: bool = False) -> None:
    """A PolyData file with inline base64 arrays."""

    def node(name: str, v: np.ndarray) -> str:
        v = np.ascontiguousarray(v, "<f8" if v.dtype.kind == "f" else "<i8")
        raw = v.tobytes()
        if compressed:
            packed = zlib.compress(raw)
            data = base64.b64encode(struct.pack("<IIII", 1, len(raw), 0, len(packed))).decode() + base64.b64encode(packed).decode()
        else:
            data = base64.b64encode(struct.pack("<I", len(raw)) + raw).decode()
        n = v.shape[1] if v.ndim == 2 else 1
        return f'<DataArray type="{"Float64" if v.dtype.kind == "f" else "Int64"}" Name="{name}" NumberOfComponents="{n}" format="binary">{data}</DataArray>'

    data = "".join(node(k, v) for k, v in arrays.items())
    where = "PointData" if association == "point" else "CellData"
    packer = ' compressor="vtkZLibDataCompressor"' if compressed else ""
    files.write(path, (f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian" header_type="UInt32"{packer}><PolyData><Piece NumberOfPoints="{len(points)}"><Points>{node("Points", points)}</Points><{where}>{data}</{where}></Piece></PolyData></VTKFile>\n').encode("ascii"))


def write_vtm(path: str, blocks: list[str]) -> None:
    """A multi-block index of files, named from its folder."""
    rows = "".join(f'<DataSet index="{i}" file="{b}"/>' for i, b in enumerate(blocks))
    files.write(path, f'<?xml version="1.0"?>\n<VTKFile type="vtkMultiBlockDataSet" version="1.0" byte_order="LittleEndian"><vtkMultiBlockDataSet>{rows}</vtkMultiBlockDataSet></VTKFile>\n'.encode("ascii"))


def write_steps(rows: DataFrame, prefix: str, arrays: dict[str, list[str]], places: tuple[str, str, str] = ("x", "y", "z"), compressed: tuple[int, ...] = (), block: int = 65_536) -> list[str]:
    """Rows with t as <prefix><step>.vtm, an index of .vtp files of about block rows that are written where the rows are, in a folder that all share. arrays: the columns of each array; compressed: steps."""
    steps = max(1, rows.select("t").distinct().count())
    parts = rows.select("t", *dict.fromkeys([*places, *[c for own in arrays.values() for c in own]])).repartition(max(1, -(-rows.count() // (steps * block))))

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, kept, number = TaskContext.get().partitionId(), {}, {}

        def flush(t: int):
            frame = pd.concat(kept.pop(t))
            name = f"{t:04d}/{part}_{number.setdefault(t, 0)}.vtp"
            number[t] += 1
            own = {k: frame[c[0] if len(c) == 1 else c].to_numpy() for k, c in arrays.items()}
            write_vtp(f"{prefix}{name}", frame[list(places)].to_numpy(), own, compressed=t in compressed)
            return pd.DataFrame({"t": [t], "part": [part], "number": [number[t]], "name": [name]})

        for batch in batches:
            for t, frame in batch.groupby("t"):
                kept.setdefault(int(t), []).append(frame)
                if sum(map(len, kept[int(t)])) >= 2 * block:
                    yield flush(int(t))
        for t in sorted(kept):
            yield flush(t)

    # a row for each file; ordered here, as Spark would write them twice to find ranges
    found = sorted(parts.mapInPandas(write, "t int, part int, number int, name string").collect())
    folder, paths = prefix.rpartition("/")[2], []
    for t in sorted({r["t"] for r in found}):
        paths.append(f"{prefix}{t:04d}.vtm")
        write_vtm(paths[-1], [folder + r["name"] for r in found if r["t"] == t])
    return paths
