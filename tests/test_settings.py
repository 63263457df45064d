import pytest

from voltrace.settings import Settings, SettingsError, configure_logging


def test_environment(monkeypatch, tmp_path):
    monkeypatch.setenv("VOLTRACE_DATA_DIR", f"{tmp_path}/d")
    monkeypatch.setenv("VOLTRACE_DEBUG", "yes")
    monkeypatch.setenv("VOLTRACE_SHUFFLE_PARTITIONS", "12")
    got = Settings.from_environment()
    assert got.debug and got.shuffle_partitions == 12 and configure_logging(got).level == 10
    for name, bad in (("VOLTRACE_DEBUG", "maybe"), ("VOLTRACE_SHUFFLE_PARTITIONS", "0")):
        monkeypatch.setenv(name, bad)
        with pytest.raises(SettingsError):
            Settings.from_environment()
        monkeypatch.setenv(name, "1")
