"""The set of library tables an operator works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from circdesk.model.schema import DDL


class Tables:
    """One attribute per library table; a table given as a function is set up on first use."""

    the_loai: DataFrame
    tac_gia: DataFrame
    sach: DataFrame
    tac_gia_sach: DataFrame
    nhan_vien: DataFrame
    doc_gia: DataFrame
    the_thu_vien: DataFrame
    phieu_muon: DataFrame
    chi_tiet: DataFrame
    hoa_don: DataFrame
    yeu_cau_gia_han: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if set(tables) != set(DDL):
            raise ValueError(f"tables wanted: {sorted(DDL)}, given: {sorted(tables)}")
        self._sources = tables
        self._counts: dict[str, Callable[[], DataFrame]] = {}

    def counted(self, **counts: Callable[[], DataFrame]) -> Tables:
        """The same set with kept-up counts of loan lines: ``dem_sach`` and ``dem_the``, by status."""
        self._counts = counts
        return self

    def count_of(self, name: str) -> DataFrame | None:
        """The kept-up count (key, trang_thai_muon, so_dong), or None if the lines must be counted."""
        return self._counts[name]() if name in self._counts else None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DDL:
            raise AttributeError(name)
        source = self._sources[name]
        table = source if isinstance(source, DataFrame) else source()
        setattr(self, name, table)
        return table

    def having(self, **changed: DataFrame) -> Tables:
        """The same set with some tables replaced by newer versions; counts stay if their tables do."""
        counts = {} if {"chi_tiet", "phieu_muon"} & set(changed) else self._counts
        return Tables(**{**self._sources, **changed}).counted(**counts)

    @classmethod
    def names(cls) -> list[str]:
        return list(DDL)
