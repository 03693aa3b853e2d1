"""Files of any store that pyarrow opens, and output files that appear only when all tasks of a job are done."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def visible(path: str) -> list[fs.FileInfo]:
    """What a folder holds that is a file and not hidden, by name; a file alone is its own list."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    found = store.get_file_info(fs.FileSelector(at))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)


def whole_path(path: str, info: fs.FileInfo) -> str:
    """The path or URI of a file found under `path`."""
    _, at = opened(path)
    return (path[: path.index("://") + 3 + path.split("://", 1)[1].find(at)] if "://" in path else "") + info.path


class Staging:
    """A hidden folder beside the results, one for each job, in which each attempt of a task writes files of its own.

    What the attempts that count have written is moved into place at the end;
    whatever else lies there, from attempts that failed or from executors that
    were lost, goes with the folder.  Where the end is told by another process
    than the beginning, as in streams, `job` is the same in both, and no two
    jobs with it share a path.
    """

    def __init__(self, path: str, job: str | None = None):
        self.path, self.job, self.fixed = path.rstrip("/"), job or uuid.uuid4().hex, job is not None
        if not self.fixed:
            store, _, folder = self._folder()
            store.create_dir(folder, recursive=True)

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, at = opened(self.path)
        return store, at, f"{at}/.staging-{self.job}"

    def create(self):
        """(name in the folder, stream to write to); an attempt that outlives its job finds no folder, unless the job has a fixed one."""
        store, _, folder = self._folder()
        if self.fixed:
            store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        return name, store.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)

    def publish(self, files: list[tuple[str, str]], replaces: str | None = None) -> None:
        """Moves (staged name, final name) into place; files that begin with `replaces` and are not among them go."""
        store, at, folder = self._folder()
        if not files and not replaces:
            return self.discard()
        store.create_dir(at, recursive=True)
        final = {name for _, name in files}
        if replaces:
            for f in visible(self.path):
                if f.base_name.startswith(replaces) and f.base_name not in final:
                    store.delete_file(f.path)
        for staged, name in files:
            store.move(f"{folder}/{staged}", f"{at}/{name}")
        self.discard()

    def discard(self) -> None:
        store, _, folder = self._folder()
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)
