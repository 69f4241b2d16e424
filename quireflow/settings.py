"""Options of a conversion run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

#: Written as Info Producer into every output, and looked for before converting: makes runs idempotent.
PRODUCER = "Quireflow"


@dataclass(frozen=True)
class Settings:
    dpi_cap: int = 300
    photo_dpi_cap: int = 150
    ocr: bool = True
    jpeg_quality: float = 0.6
    min_saving_fraction: float = 0.2
    min_g4_dpi: int = 150
    max_g4_damage: float = 0.40
    demoted_text_format: str = "gray4"
    remove_scan_edges: bool = True
    probe_dpi: int = 100
    ocr_dpi: int = 150

    @property
    def text_dpi(self) -> int:
        return max(72, self.dpi_cap)

    @property
    def probe_render_dpi(self) -> int:
        return min(self.probe_dpi, self.text_dpi)

    def gray_dpi(self, native: int) -> int:
        """Resolution of pages that stay gray."""
        return max(72, min(native, self.photo_dpi_cap))
