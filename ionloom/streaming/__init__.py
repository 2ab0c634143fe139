"""Row-local operators on arriving spectra."""
